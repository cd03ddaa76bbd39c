"""Sharding by sampled splitters: shards of near equal bytes along one global order of keys.

The key of a record is a hash of its text, so equal texts lie side by side; records of one key are ordered by a hash of
their id. Splitters are quantiles of a size-weighted sample of the keys. Every splitter key is a range of its own and
so is what lies between two of them. A range with more than ``cell_rows`` rows is divided further into cells, evenly by
key or, for the range of one key, by the id's hash. A cell that is crowded nevertheless holds a key that was not drawn,
such as that of the empty text: each of its heavy keys gets pieces of its own, by the id's hash, and what is crowded
then, rows of one key and one id, is cut by a stored random number. So a task gets about ``cell_rows`` rows, or a
``MOST_HEAVY``-th of all where that is more. Cells are counted exactly; a record's place is its cell's offset and the
running sum within the cell. Record i with ``b`` bytes before it goes to shard floor(shards * (b + size / 2) / total):
the shards differ by about one record, whatever the sample was.

Only DataFrame functions run; the driver sees the splitters, one row a range, and one a shard. Defined cases: a null text is
an empty one of size 1; null ids are ordered like the text ""; repeated rows get a slot each; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import hash60, no_text, stage

SHARDS, SPLITTERS, SAMPLE, CELL_ROWS, MOST_HEAVY, STEP = 16, 255, 8192, 500, 65_536, 16
KEYS = 1 << 60
CELL = ["range", "cell", "piece", "slice", "piece2", "slice2"]


def sample_splitters(rows: DataFrame, total: int, splitters: int = SPLITTERS, sample: int = SAMPLE) -> list[int]:
    """Quantile keys of about ``sample`` draws, each record drawn in proportion to its size; ``sample`` bounds the draws."""
    expected = F.col("size") * (sample / max(total, 1))
    draws = F.floor(expected + F.col("tie") / float(KEYS)).cast("int")  # the id's hash is the dice
    drawn = rows.withColumn("draws", draws).filter("draws > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), "draws")))
    steps = [(i + 1) / (splitters + 1) for i in range(splitters)]
    found = drawn.agg(F.percentile_approx("key", steps, 100_000).alias("keys")).first()["keys"]
    return sorted(set(found or []))


def _part(at: Column, parts: Column) -> Column:
    """The one of ``parts`` even parts of [0, KEYS) that ``at`` lies in."""
    within = F.floor(at / F.lit(float(KEYS)) * parts).cast("long")
    return F.least(F.greatest(within, F.lit(0)), parts - 1)


def split_crowded(rows: DataFrame, cell: list[str], value: Column, then: str, names: tuple[str, str], limit: int, cell_rows: int) -> DataFrame:
    """``rows`` with two more columns of the cell's name: in crowded cells, heavy values of ``value`` lie apart, divided by ``then``.

    ``value`` follows the order of the rows. More than ``limit`` rows make a cell crowded and a value heavy; ``limit``
    is a ``MOST_HEAVY``-th of all rows or more, so there are fewer than ``MOST_HEAVY`` of both: that bounds the broadcasts.
    """
    piece, part = names
    rows = rows.withColumn("value", value)
    crowded = stage(rows.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(*cell), "crowded")
    heavy = rows.join(F.broadcast(crowded), cell, "left_semi").groupBy(*cell, "value").agg(F.count("*").alias("n"))
    heavy = heavy.filter(F.col("n") > limit).groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("heavy"))
    rows = rows.join(F.broadcast(stage(heavy, "heavy")), cell, "left")
    smaller = F.coalesce(F.size(F.filter("heavy", lambda h: h["value"] < F.col("value"))), F.lit(0))
    rows = rows.withColumn("smaller", smaller).withColumn("own", F.get("heavy", F.col("smaller")))
    rows = rows.withColumn("own", F.when(F.col("own.value") == F.col("value"), F.col("own.n")))
    parts = F.ceil(F.col("own") / cell_rows).cast("long")
    return rows.withColumns({
        piece: 2 * F.col("smaller") + F.col("own").isNotNull().cast("int"),
        part: F.when(F.col("own").isNull(), F.lit(0)).otherwise(_part(F.col(then), parts)).cast("long"),
    }).drop("value", "heavy", "smaller", "own")


def with_cells(rows: DataFrame, cuts: list[int], cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` (key, tie, dice) with the columns ``CELL``, which follow the order of (key, tie)."""
    # 2 i + 1: the i-th splitter key itself; 2 i: the keys before it
    array = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    less = lambda values: F.size(F.filter(values, lambda c: c < F.col("key")))
    bounds = array(cuts)
    rows = rows.withColumn("steps", STEP * less(array(cuts[STEP - 1 :: STEP])))
    rows = rows.withColumn("below", F.col("steps") + less(F.slice(bounds, F.col("steps") + 1, F.lit(STEP)))).drop("steps")
    on_cut = F.coalesce(F.get(bounds, F.col("below")) == F.col("key"), F.lit(False))
    rows = rows.withColumn("range", 2 * F.col("below") + on_cut.cast("int")).drop("below")
    # as many rows as there are ranges: 2 * splitters + 1 at most
    found = {r["range"]: r["n"] for r in rows.groupBy("range").agg(F.count("*").alias("n")).collect()}
    n_ranges = 2 * len(cuts) + 1
    parts = [max(1, -(-found.get(r, 0) // cell_rows)) for r in range(n_ranges)]
    edges = [0, *cuts, KEYS]
    lows = [0 if r % 2 else edges[r // 2] for r in range(n_ranges)]
    widths = [KEYS if r % 2 else max(edges[r // 2 + 1] - edges[r // 2], 1) for r in range(n_ranges)]
    of = lambda values: F.get(array(values), F.col("range"))
    at = F.when(F.col("range") % 2 == 1, F.col("tie")).otherwise(F.col("key"))
    within = F.floor((at - of(lows)) / of(widths).cast("double") * of(parts)).cast("long")
    rows = rows.withColumn("cell", F.least(F.greatest(within, F.lit(0)), of(parts) - 1))
    limit = max(cell_rows, -(-sum(found.values()) // MOST_HEAVY))
    rows = split_crowded(rows, CELL[:2], F.col("key"), "tie", (CELL[2], CELL[3]), limit, cell_rows)
    return split_crowded(rows, CELL[:4], F.struct("key", "tie"), "dice", (CELL[4], CELL[5]), limit, cell_rows)


def shard_by_splitters(
    docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text",
    splitters: int = SPLITTERS, sample: int = SAMPLE, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Per document: id, size (UTF-8 bytes + 1), text_crc32, shard, slot (from 0 in each shard, in the order of keys)."""
    body = no_text(text)
    ident = F.coalesce(F.col(id).cast("string"), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            hash60(body).alias("key"), hash60(F.concat(ident, F.lit(":shard"))).alias("tie"),
            (F.rand(0) * float(KEYS)).cast("long").alias("dice"),
        ),
        "keys",
    )
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    cuts = sample_splitters(rows, total, splitters, sample)
    n_ranges = 2 * len(cuts) + 1
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]).cast("array<bigint>"), F.col("range"))
    rows = stage(with_cells(rows, cuts, cell_rows), "rows-in-cells")
    cells = stage(rows.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "cells")
    before = Window.partitionBy("range").orderBy(*CELL[1:]).rowsBetween(Window.unboundedPreceding, -1)
    in_range = {r["range"]: (r["n"], r["bytes"]) for r in cells.groupBy("range").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    row_base, byte_base, n, b = [], [], 0, 0
    for r in range(n_ranges):
        row_base.append(n)
        byte_base.append(b)
        n, b = n + in_range.get(r, (0, 0))[0], b + in_range.get(r, (0, 0))[1]
    cells = cells.select(
        *CELL,
        (of(row_base) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("rows_before"),
        (of(byte_base) + F.coalesce(F.sum("bytes").over(before), F.lit(0))).alias("bytes_before"),
    )
    order = Window.partitionBy(*CELL).orderBy("key", "tie", "id", "size")
    placed = rows.join(cells, CELL).select(
        "id", "size", "text_crc32",
        (F.col("rows_before") + F.row_number().over(order) - 1).alias("row"),
        (F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("byte"),
    )
    middle = (F.lit(2 * shards).cast("decimal(38,0)") * F.col("byte") + F.lit(shards) * F.col("size")) / F.lit(2 * max(total, 1)).cast("decimal(38,0)")
    placed = stage(placed.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int")), "places")
    first = {r["shard"]: r["row"] for r in placed.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    firsts = F.get(F.array(*[F.lit(first.get(s, 0)) for s in range(shards)]).cast("array<bigint>"), F.col("shard"))
    return placed.select(F.col("id").alias(id), "size", "text_crc32", "shard", (F.col("row") - firsts).alias("slot"))


#: CRC-32 (polynomial EDB88320) by table, a byte at a time.
CRC_SQL = r"""
tab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM documents, tab)
"""

SQL = "WITH " + CRC_SQL.strip() + r""",
k AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    ('0x' || md5(coalesce(text, ''))[1:15])::BIGINT AS key,
    ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':shard')[1:15])::BIGINT AS tie FROM documents),
p AS (SELECT *, sum(size) OVER o - size AS b, sum(size) OVER () AS t, row_number() OVER o - 1 AS r
    FROM k WINDOW o AS (ORDER BY key, tie, doc_id, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least((32 * b + 16 * size) // (2 * t), 15)::INT AS shard FROM p)
SELECT s.doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
    (r - min(r) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s JOIN crc USING (doc_id)
"""
