"""Models; importing this package registers all of them."""

from tidebar.models import calibration, stacking, trees  # noqa: F401
from tidebar.models.base import create_model, list_models, register_model  # noqa: F401
