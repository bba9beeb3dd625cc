"""The full query catalogue (importing each module registers its queries)."""

from . import q_clean, q_features, q_ml, q_panel, q_serving, q_summary  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
