"""The trie of conversations against a plain one."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from tidebar.llm.conversation_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, rep long, n long, path string, words int"


def plain_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    nodes = collections.defaultdict(list)
    built = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        built[conv] = tuple(own.get(base, [])[:h] + own[conv][h:])
        for d in range(len(built[conv]) + 1):
            nodes[built[conv][:d]].append(conv)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        cost = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += cost
    ends = collections.defaultdict(list)
    for conv, k in built.items():
        ends[k].append(conv)
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in nodes.items()
    )


def made(seed, convs=150):
    rng = random.Random(seed)
    common = [("user", f"hello  there {k}") for k in range(3)]
    out = []
    for c in range(convs):
        if c % 7 == 3:
            continue
        turns = [rng.choice(common) for _ in range(rng.randrange(4))] + [("user", f"w{rng.randrange(5)} x") for _ in range(rng.randrange(3))]
        if c % 5 == 0:
            turns = [common[0], common[1], (None, None), ("a", "the same one"), ("b", "again"), ("", "")]
        for t, (role, text) in enumerate(turns):
            out.append((c, t, role, text))
    out += [(900, t, "user", f"turn {t // 2}") for t in range(13)] + [(901, t, "user", f"turn {t // 2}") for t in range(15)]
    out += [(902, None, "u", "late?"), (902, 0, "u", "early"), (902, 0, "u", "early"), (902, 0, "a", "tie"), (None, 0, "u", "nobody")]
    out += [(-7, 0, "u", "below zero"), (-7, 1, "u", "zero"), (-20, 0, "u", "base"), (903, 0, "u", "only")]
    out += [(1000 + k, t, "u", f"turn {t // 2}") for k in range(3) for t in range(9 + k)] + [(2000, 0, "u", "word " * 30_000)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("capacity,block_turns", [(4096, 512), (9, 512), (40, 4)])
def test_trie(spark, capacity, block_turns):
    data = made(capacity + block_turns)
    df = spark.createDataFrame([(*r, 1, 2, 3, "p", 4) for r in data], SCHEMA).repartition(5)
    got = conversation_trie(df, capacity, block_turns).collect()
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in got)
    want = plain_trie(data)
    if min(r[0] for r in data if r[0] is not None) < 0:  # the root alone has no parent
        want = sorted(want)
    assert got == want


def test_trie_of_nothing(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    got = conversation_trie(spark.createDataFrame([(5, 0, None, None, 1, 1, 1, "", 1)], SCHEMA)).collect()
    assert {(r.conv_id, r.depth, r.n_convs) for r in got} <= {(5, 0, 1), (5, 1, 1)}


def test_ids_of_a_large_group(spark, monkeypatch):
    from tidebar.llm import conversation_trie as module

    monkeypatch.setattr(module, "PIECE", 50)
    data = [(20 * c, t, "u", f"t{t}") for c in range(3000) for t in range(2)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in conversation_trie(df, 10).collect())
    assert got == plain_trie(data)
