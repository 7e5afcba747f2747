"""Running requests over a visible view: pages in row-id order, global hit counts, cursors and routes."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequest, LimitExceeded
from ..functions import canonical
from ..schema import ROW_ID, Schema
from .request import MAX_LIMIT, Request, predicate, prepare, projection, route


@dataclass
class Stats:
    hits: int
    rows_examined: int
    elapsed_micros: int
    route: str

    @property
    def optimized_equality_route(self) -> bool:
        return self.route == "equality"


@dataclass
class Page:
    """rows: (row id, [(column, canonical text or None), ...]) in row-id order."""

    rows: list[tuple[int, list[tuple[str, str | None]]]] = field(default_factory=list)
    next_cursor: int | None = None
    stats: Stats | None = None


def matches(view: DataFrame, request: Request, schema: Schema) -> DataFrame:
    """All visible rows that match the filters, whatever the cursor and limit."""
    p = predicate(prepare(request.filters, schema))
    return view if p is None else view.where(p)


def page(view: DataFrame, request: Request, schema: Schema) -> DataFrame:
    """The request's page: rows after the cursor, in row-id order, projected to canonical text."""
    if request.limit < 1:
        raise InvalidRequest("limit must be at least 1")
    found = matches(view, request, schema)
    if request.after_row_id is not None:
        found = found.where(F.col(ROW_ID) > F.lit(request.after_row_id))
    names = projection(request.select, schema)
    unique = list(dict.fromkeys(names))
    values = [canonical.text(F.col(f"`{n}`"), schema[n]).alias(n) for n in unique]
    return found.select(ROW_ID, *values).orderBy(ROW_ID).limit(request.limit)


def hits(view: DataFrame, request: Request, schema: Schema) -> int:
    return matches(view, request, schema).count()


def rows_examined(view: DataFrame, request: Request, schema: Schema, last: int | None = None) -> int:
    """Rows that the logical route looks at, by rule; no task is instrumented."""
    prepared = prepare(request.filters, schema)
    kind = route(prepared)
    if kind in ("equality", "range_decomposed"):
        return 0
    if kind == "candidate_first":
        return view.where(predicate([p for p in prepared if p.op == "eq"])).count()
    if kind == "browse":
        # ids are walked from the cursor to the page's end, gaps included
        start = request.after_row_id + 1 if request.after_row_id is not None else 0
        return 0 if last is None else last - start + 1
    return view.count()


def run(view: DataFrame, request: Request, schema: Schema, max_row_id: int | None = None) -> Page:
    """The page with its statistics: one job for the page, one for the count, and one more where the route examines rows."""
    if request.limit > MAX_LIMIT:
        raise InvalidRequest(f"limit is at most {MAX_LIMIT}")
    began = time.monotonic()
    kind = route(prepare(request.filters, schema))
    names = projection(request.select, schema)
    bounded = request.max_rows_examined is not None
    if bounded and kind in ("candidate_first", "scan"):
        examined = rows_examined(view, request, schema)
        if examined > request.max_rows_examined:
            raise LimitExceeded(f"the query examines {examined} rows; the limit is {request.max_rows_examined}")
    else:
        examined = None
    spark = view.sparkSession
    group = f"query-{id(request)}-{time.monotonic_ns()}"
    timer = None
    if request.timeout_ms is not None:
        import threading

        spark.addTag(group)
        timer = threading.Timer(request.timeout_ms / 1000, spark.interruptTag, [group])
        timer.start()
    try:
        rows = page(view, request, schema).collect()
        total = hits(view, request, schema)
        last = rows[-1][ROW_ID] if rows else None
        if examined is None:
            examined = rows_examined(view, request, schema, last)
    except Exception as e:
        if timer is not None and not timer.is_alive():
            raise LimitExceeded(f"the query ran longer than {request.timeout_ms} ms") from e
        raise
    finally:
        if timer is not None:
            timer.cancel()
            spark.removeTag(group)
    if bounded and examined > request.max_rows_examined:
        raise LimitExceeded(f"the query examines {examined} rows; the limit is {request.max_rows_examined}")
    more = len(rows) == request.limit and (kind != "browse" or max_row_id is None or last < max_row_id)
    out = [(r[ROW_ID], [(n, r[n]) for n in names]) for r in rows]
    stats = Stats(total, examined, int((time.monotonic() - began) * 1e6), kind)
    return Page(out, last if more else None, stats)
