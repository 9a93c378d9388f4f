"""Paged scans of a whole collection by keyset cursors.

The rows are range-partitioned by key once. A row's place in the scan is its place in its
partition plus the sizes of the partitions before, so pages and their cursors need one small
count per partition and no global sort. A page is fetched by its cursor alone: a key range,
which reaches the files as a filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.session import materialize

PAGE_ROWS = 1000
# monotonically_increasing_id: the partition above, the row within it below.
_ROW_BITS = 33


def live(items: DataFrame, memory_layer: str | None = None, include_deprecated: bool = False) -> DataFrame:
    """What a scan covers: one layer or all, deprecated items only on demand."""
    if not include_deprecated:
        items = items.filter(~F.coalesce("is_deprecated", F.lit(False)))
    return items if memory_layer is None else items.filter(F.col("memory_layer") == memory_layer)


@dataclass(frozen=True)
class PagedScan:
    """``rows`` in key order with their page; ``pages``: page, start, next_offset, held."""

    rows: DataFrame
    pages: DataFrame
    key: str

    def fetch(self, offset=None) -> tuple[DataFrame, object]:
        """The page that starts at a cursor (the first one without), and the next cursor or None."""
        at = self.pages.filter(F.col("page") == 0 if offset is None else F.col("start") == F.lit(offset)).first()
        if at is None:
            if offset is not None:
                raise KeyError(f"no page starts at {offset!r}")
            return self.rows.limit(0).drop("page"), None
        page = self.rows.filter(F.col(self.key) >= F.lit(at["start"]))
        if at["next_offset"] is not None:
            page = page.filter(F.col(self.key) < F.lit(at["next_offset"]))
        return page.drop("page"), at["next_offset"]


def _place(total: Column) -> Column:
    return total + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def scan_pages(items: DataFrame, key: str = "id", page_rows: int = PAGE_ROWS) -> PagedScan:
    """Write the items (unique, non-null ``key``) in key order and cut them into pages.

    The layout is written once; a scan that is resumed later, or by another reader, sees the
    same pages.
    """
    rows = materialize(items.repartitionByRange(key).sortWithinPartitions(key).withColumn(
        "_at", F.monotonically_increasing_id()), "scan-rows")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition of the scan, so a single window is small whatever the items are.
    before = materialize(sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias(
        "_before")), "scan-offsets")
    placed = rows.join(F.broadcast(before), part == F.col("_part")).withColumn(
        "page", F.floor(_place(F.col("_before")) / page_rows).cast("long"))
    pages = placed.groupBy("page").agg(F.min(key).alias("start"), F.count(F.lit(1)).alias("held"))
    pages = materialize(pages, "scan-pages")
    following = pages.select((F.col("page") - 1).alias("page"), F.col("start").alias("next_offset"))
    return PagedScan(placed.select(*items.columns, "page"), materialize(pages.join(following, "page", "left").select(
        "page", "start", "next_offset", "held"), "scan-cursors"), key)
