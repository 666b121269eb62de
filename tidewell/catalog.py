"""Every registered query of the engine with its SQL."""

from __future__ import annotations

from tidewell.plans import customer, learned, messages, privacy, recommend, streams
from tidewell.plans.registry import Query

AREAS = (customer.area, recommend.area, privacy.area, messages.area, learned.area, streams.area)


def queries() -> dict[str, Query]:
    return {name: f for area in AREAS for name, f in area.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.sql.items()}
