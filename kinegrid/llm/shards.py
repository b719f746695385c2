"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are put in a seeded random order within their stratum. Row ``r`` of a stratum with ``n`` rows
gets the fractional rank ``(2r + 1) / 2n``; all rows are ordered by it and cut into shards whose row
counts differ by one at most. Each stratum is spread evenly over the fractional ranks, so every cut
holds the mixture of the whole table.

No rank is taken over a whole stratum or the whole table in one task. The order key is dealt into
cells of about ``CELL_ROWS`` rows, cells are counted and summed up in two levels, and ``row_number`` runs within a
cell only. A stratum with a third of all rows is just a stratum with more cells. Rows that are equal in all that the order
sees are counted first and numbered in blocks, and the number takes part in the order key, so neither a
repeated key nor a null one fills a cell.

Defined cases: a null text has no bytes (size 8) and the crc32 of an empty text; null strata form a stratum of
their own; rows with equal keys are ordered by size and crc32; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrid.llm.common import stratum_key

CELL_ROWS = 4096
#: Cells of a span: a task sums up the cells of a span, or the spans of a stratum.
SPAN = 4096
OVERHEAD = 8


def _cell(unit, cells: int):
    """The cell of a value in [0, 1)."""
    return F.least(F.floor(unit * cells), F.lit(cells - 1)).cast("long")


def _running(counts: DataFrame, *within: str) -> DataFrame:
    """Adds to (within, c, n) how many rows stand before cell c (off) and the number of all (every); a task sums SPAN cells or SPAN-fold sums of them."""
    counts = counts.withColumn("span", F.expr(f"div(c, {SPAN})"))
    whole = Window.partitionBy(*within)
    sums = counts.groupBy(*within, "span").agg(F.sum("n").alias("m"))
    sums = sums.select(
        *within,
        "span",
        F.coalesce(F.sum("m").over(whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("m").over(whole).alias("every"),
    )
    inside = Window.partitionBy(*within, "span").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(sums, [*within, "span"]).select(*within, "c", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("off"), "every")


def interleaved_shards(
    docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", stratum: str = "source", seed: int = 17
) -> DataFrame:
    """One row per input row: key, stratum, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = docs.select(
        F.col(key).alias("k"),
        stratum_key(F.col(stratum)).alias("s"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
    )
    total = docs.count()
    cells = max(1, -(-total // CELL_ROWS))
    same = ["k", "s", "size", "crc"]
    equal = kinds.groupBy(*same).agg(F.count("*").alias("n"))
    few = equal.where(F.col("n") <= CELL_ROWS).select(*same, F.lit(0).cast("long").alias("b"), "n")
    many = equal.where(F.col("n") > CELL_ROWS)
    many = many.select(*same, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"div(n - 1, {CELL_ROWS})"))).alias("b"))
    many = many.select(*same, "b", F.least(F.lit(CELL_ROWS), F.col("n") - F.col("b") * CELL_ROWS).alias("n")).repartition(*same, "b")
    rows = few.unionByName(many).select(*same, F.explode(F.sequence(F.col("b") * CELL_ROWS, F.col("b") * CELL_ROWS + F.col("n") - 1)).alias("e"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "k", "size", "crc", "e"))
    unit = F.shiftrightunsigned(F.col("h"), 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("c", _cell(unit, cells))

    counts = _running(rows.groupBy("s", "c").agg(F.count("*").alias("n")), "s")
    inside = Window.partitionBy("s", "c").orderBy("h", "k", "size", "crc", "e")
    ranked = (
        rows.withColumn("i", F.row_number().over(inside) - 1)
        .join(counts, ["s", "c"])
        .withColumn("f", (2 * (F.col("off") + F.col("i")) + 1) / (2.0 * F.col("every")))
        .select(*same, "e", "f")
        .withColumn("c", _cell(F.col("f"), cells))
    )
    # The cells of fractional ranks hold about CELL_ROWS rows each, whatever the strata.
    share = _running(ranked.groupBy("c").agg(F.count("*").alias("n")))
    place = Window.partitionBy("c").orderBy("f", "s", "k", "size", "crc", "e")
    pos, n, m = F.col("pos"), F.lit(max(1, total)), F.lit(shards)
    shard = F.floor(((pos + 1) * m - 1) / n) if total * shards < (1 << 52) else F.expr(f"div((pos + 1) * {shards} - 1, {max(1, total)})")
    return (
        ranked.withColumn("i", F.row_number().over(place) - 1)
        .join(share, "c")
        .withColumn("pos", F.col("off") + F.col("i"))
        .withColumn("shard", shard.cast("int"))
        .select(
            F.col("k").alias(key),
            F.col("s").alias("stratum"),
            "size",
            F.col("crc").alias("text_crc32"),
            "shard",
            (pos - F.expr(f"div(cast(shard as bigint) * {total}, {shards})")).alias("slot"),
        )
    )
