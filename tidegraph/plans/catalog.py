"""All registered queries of the time-shape library and their SQL."""

from __future__ import annotations

from .oracles import SQL
from .queries import FOUND, Query


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
