"""All registered queries (importing the plan modules registers them)."""

from __future__ import annotations

from . import io_plans, metrics, normalizers, scoring, shaping, surfaces, training  # noqa: F401  (register)
from .registry import ORACLE, QUERIES
from .rounding import ROUND_COLUMNS


def queries():
    return dict(QUERIES)


def _rounded(name: str, sql: str) -> str:
    """Round the DOUBLE (and ARRAY<DOUBLE>) outputs to 6 places, exactly as
    the Spark side does (see ``registry.register``)."""
    if name not in ROUND_COLUMNS:
        return sql
    dbl, arr = ROUND_COLUMNS[name]
    reps = [f'round("{c}", 6) AS "{c}"' for c in dbl]
    reps += [f'list_transform("{c}", lambda x: round(x, 6)) AS "{c}"' for c in arr]
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{sql}\n) AS oracle_q"


def oracle_sql():
    return {k: _rounded(k, v) for k, v in ORACLE.items() if k in QUERIES}
