"""Feature sets; importing this package registers all of them."""

from tidebar.features import external, price, proxies  # noqa: F401
from tidebar.features.registry import get_feature_set, list_feature_sets, register_feature_set  # noqa: F401
