"""All registered queries."""

from . import queries_context, queries_facts, queries_functions, queries_history, queries_io, queries_kill, queries_merge, queries_status  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
