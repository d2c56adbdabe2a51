"""All registered queries and their SQL twins."""

from . import q_curate, q_detect, q_features, q_metrics, q_ml, q_resample, q_sources, q_spans, q_text  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
