"""Latest rows, pages and caps.

Only sort keys and ids are sorted; the chosen ids then fetch their rows, so article
texts never take part in a sort.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swaymeter.functions.base import newest_first


@dataclass
class Page:
    """Rows of a page in order; `keys` are just its keys and positions, at most one page of them."""

    rows: DataFrame
    keys: DataFrame
    number: int
    num_pages: int
    total: int


def newest_order(time: str = "posting_time", key: str = "id") -> list[Column]:
    """Newest first, undated rows before all others, then by id."""
    return [newest_first(time), F.asc(key)]


def latest(df: DataFrame, n: int, time: str = "posting_time", key: str = "id") -> DataFrame:
    return df.orderBy(*newest_order(time, key)).limit(n)


def clamp_page(page: object, num_pages: int) -> int:
    """Anything but an integer means the first page; out of range means the last."""
    try:
        number = int(str(page))
    except ValueError:
        return 1
    return number if 1 <= number <= num_pages else num_pages


def _reverse(order: Sequence[tuple[str, bool, bool]]) -> list[tuple[str, bool, bool]]:
    return [(name, not asc, not nulls_first) for name, asc, nulls_first in order]


def _columns(order: Sequence[tuple[str, bool, bool]]) -> list[Column]:
    out = []
    for name, asc, nulls_first in order:
        c = F.col(name)
        if asc:
            out.append(c.asc_nulls_first() if nulls_first else c.asc_nulls_last())
        else:
            out.append(c.desc_nulls_first() if nulls_first else c.desc_nulls_last())
    return out


NEWEST = [("posting_time", False, True), ("id", True, False)]


def paginate(df: DataFrame, page: object, size: int, order: Sequence[tuple[str, bool, bool]] = NEWEST,
             key: str = "id") -> Page:
    """Page `page` of the rows in a total order, given as (column, ascending, nulls first).

    `key` must be unique. Rows come in page order, with their place in the whole order in `position` (from 1). Only
    keys are sorted, from the nearer end; a reader who walks on from page to page uses `page_after`, which costs the
    same however far it has come.
    """
    total = df.count()
    num_pages = max(1, -(-total // size))
    number = clamp_page(page, num_pages)
    skip = (number - 1) * size
    take = max(0, min(size, total - skip))
    names = list(dict.fromkeys([n for n, _, _ in order] + [key]))
    keys = df.select(*names)
    behind = total - skip - take
    if skip <= behind:
        chosen = keys.orderBy(*_columns(order)).offset(skip).limit(take)
    else:
        chosen = keys.orderBy(*_columns(_reverse(order))).offset(behind).limit(take)
    numbered = _numbered(chosen, order, key, skip)
    return Page(_rows_of(df, numbered, key), numbered, number, num_pages, total)


#: Parts (days, first letters) that a page directory may have.
MAX_PARTS = 100_000


def paginate_by_part(df: DataFrame, page: object, size: int, part: Column, order: Sequence[tuple[str, bool, bool]] = NEWEST,
                     key: str = "id", within: Callable[[list], Column] | None = None) -> Page:
    """As `paginate`, by a directory of counts per `part`, so that only the parts of the page are sorted.

    `part` must grow with the first column of the order (its day, its first letter) and be null where that is. `within`
    gives a further filter for a list of parts, e.g. one on the folders in which their rows lie, which lets the scan skip all
    others. More than MAX_PARTS parts are an error: take coarser ones.
    """
    counts = df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).limit(MAX_PARTS + 1).collect()
    if len(counts) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} parts")
    _, asc, nulls_first = order[0]
    known = sorted(((r["part"], r["n"]) for r in counts if r["part"] is not None), reverse=not asc)
    unknown = [(r["part"], r["n"]) for r in counts if r["part"] is None]
    directory = unknown + known if nulls_first else known + unknown
    total = sum(n for _, n in directory)
    num_pages = max(1, -(-total // size))
    number = clamp_page(page, num_pages)
    skip = (number - 1) * size
    chosen, before, first = [], 0, None
    for value, n in directory:
        if before + n > skip and before < skip + size:
            chosen.append(value)
            first = before if first is None else first
        before += n
    some = [v for v in chosen if v is not None]
    own = part.isin(some) if some else F.lit(False)
    own = own | part.isNull() if len(some) < len(chosen) else own
    rows = df.filter(F.coalesce(own, F.lit(False)) & (within(chosen) if within else F.lit(True)))
    names = list(dict.fromkeys([n for n, _, _ in order] + [key]))
    keys = rows.select(*names).orderBy(*_columns(order)).offset(skip - (first or 0)).limit(size)
    numbered = _numbered(keys, order, key, skip)
    return Page(_rows_of(rows, numbered, key), numbered, number, num_pages, total)


def page_after(df: DataFrame, size: int, last: Mapping[str, object] | None = None,
               order: Sequence[tuple[str, bool, bool]] = NEWEST, key: str = "id") -> DataFrame:
    """The next `size` rows after the row whose order columns are `last` (None: the first rows), in order.

    A filter and a top-n: every task sends at most `size` keys.
    """
    keys = df if last is None else df.filter(_behind(order, last))
    chosen = keys.select(*dict.fromkeys([n for n, _, _ in order] + [key])).orderBy(*_columns(order)).limit(size)
    return _rows_of(df, _numbered(chosen, order, key, 0), key)


def _behind(order: Sequence[tuple[str, bool, bool]], last: Mapping[str, object]) -> Column:
    """Whether a row stands behind `last` in the order."""
    behind = F.lit(False)
    for name, asc, nulls_first in reversed(order):
        value, c = last[name], F.col(name)
        if value is None:
            further = c.isNotNull() if nulls_first else F.lit(False)
        else:
            further = c > F.lit(value) if asc else c < F.lit(value)
            further = F.coalesce(further, F.lit(not nulls_first))
        behind = further | (c.eqNullSafe(F.lit(value)) & behind)
    return behind


def _numbered(chosen: DataFrame, order, key: str, skip: int) -> DataFrame:
    """At most one page of chosen keys with their positions; the window spans these rows only."""
    place = F.row_number().over(Window.orderBy(*_columns(order))) + skip
    return chosen.withColumn("position", place.cast("bigint")).select(key, "position")


def _rows_of(df: DataFrame, numbered: DataFrame, key: str) -> DataFrame:
    return df.join(F.broadcast(numbered), key).select(*df.columns, "position").orderBy("position")


def shared_folder(spark) -> str:
    """Folder for intermediate tables that driver and executors share: `spark.checkpoint.dir`."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def first_ids_cutoff(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Largest of the n smallest ids, as a one-row table."""
    return df.select(key).orderBy(key).limit(n).agg(F.max(key).alias("cutoff"))


def mark_first(df: DataFrame, n: int, key: str = "id", name: str = "is_anchor") -> DataFrame:
    """Flag the n rows with the smallest ids."""
    cutoff = first_ids_cutoff(df, n, key).scalar()
    return df.withColumn(name, F.coalesce(F.col(key) <= cutoff, F.lit(False)))


def capped(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """At most n rows in a fixed order; no n, no cap."""
    return df if n is None else df.orderBy(*(order or ("id",))).limit(n)
