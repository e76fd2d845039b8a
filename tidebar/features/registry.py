"""Named feature sets: Frame -> Frame functions with the rows they look back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tidebar.operators.frame import Frame


@dataclass(frozen=True)
class FeatureSet:
    name: str
    build: Callable[[Frame], Frame]
    lookback: int
    sources: tuple[str, ...] = ()
    stacked: bool = False  # reads columns other sets made, so look-backs add up
    running: Callable[[Frame], tuple[Frame, dict]] | None = None  # inputs of its running aggregates


_SETS: dict[str, FeatureSet] = {}


def register_feature_set(
    name: str, lookback: int, sources: tuple[str, ...] = (), stacked: bool = False,
    running: Callable[[Frame], tuple[Frame, dict]] | None = None,
):
    """Decorator; ``lookback`` is the number of earlier rows a value depends on.

    ``running`` optionally returns the frame with the inputs, and the specs, of
    the set's running aggregates; it lets the carries of all sets come from one
    pass.  Without it they are computed when the set asks for them.
    """

    def wrap(build: Callable[[Frame], Frame]):
        _SETS[name] = FeatureSet(name, build, lookback, sources, stacked, running)
        return build

    return wrap


def get_feature_set(name: str) -> FeatureSet:
    if name not in _SETS:
        raise KeyError(f"unknown feature set '{name}', available: {sorted(_SETS)}")
    return _SETS[name]


def list_feature_sets() -> list[str]:
    return list(_SETS)


def attach_running(frame: Frame, names: list[str]) -> Frame:
    """Carries of all running aggregates of the sets, joined in one go."""
    source, specs = frame, {}
    for s in (get_feature_set(n) for n in names):
        if s.running:
            source, own = s.running(source)
            specs |= own
    return frame.attach_carries(specs, source) if specs and frame.blocked else frame


def total_lookback(names: list[str]) -> int:
    sets = [get_feature_set(n) for n in names]
    plain = max([s.lookback for s in sets if not s.stacked], default=0)
    return plain + sum(s.lookback for s in sets if s.stacked)
