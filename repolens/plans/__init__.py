"""Registered queries: each builds its plan from the driver tables with the
operators of this package; ``ORACLE`` holds the DuckDB twin statements."""

from . import (audit_plans, code_plans, corpus_plans, graph_plans, response_plans,  # noqa: F401
               session_plans, summary_plans)
from . import stream_plans  # noqa: F401,E402  (reuses oracles registered above)
from .registry import ORACLE, QUERIES  # noqa: F401
