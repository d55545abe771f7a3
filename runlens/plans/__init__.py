"""The registered queries: which tables play which roles, and the same in SQL."""

from . import aggregates, evaluation, joins, ordered, paired, records, statistics, text, trees  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
