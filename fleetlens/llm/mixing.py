"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: the words of all documents are shared by weight; a source's target stops at ``epochs`` times its words, and
the excess goes to the others by weight. With the sources in the order of words a unit of weight can take, the full
ones come first, so one running sum finds them.

Blocks of ``block`` words go to the sources by the highest quotients target / (2 s - 1), and each source's blocks go to
its shards (bounded numbers of documents, dealt by hash) by the same rule over the shards' words: integer quotas. All
seats above a proven quotient are given at once, and only about two a party are ranked, so no row a seat is made.

Selection: the documents of a shard lie in seeded order on one line, cut into blocks. A quota takes the line as often
as it goes, and the rest is a run of whole blocks from a seeded start, around the end; so documents stay whole but for
those at a run's ends.

Only DataFrame functions run. Defined cases: null text: size 0; null source: a source of its own, the last; a size
of 0 takes 0; repeated rows are documents of their own; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import hash60, no_text, stage, words

BLOCK, EPOCHS, SHARD_ROWS, SEED = 32, 3, 1000, "mix"


def with_targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (src, words, weight) with ``target``. One row a source: a table of names, not of documents."""
    sources = sources.withColumn("cap", epochs * F.col("words"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("words").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = sources.withColumn("full", F.col("cap") / F.col("weight") <= left / weight)
    open_words = F.sum("words").over(everything) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * open_words / open_weight)
    return full.withColumn("target", target.cast("double")).drop("cap", "full")


def apportion(parties: DataFrame, house: list[str], party: str, weight: str, seats: Column) -> DataFrame:
    """Sainte-Laguë: ``parties`` with ``quota``, the seats by highest quotients weight / (2 s - 1), ties to the first party.

    With N seats, n parties and W their weight, the seats with quotients of W / (2 N - n) and more are N at most, those
    of W / (2 N + n) and more are N at least; only the seats between are ranked.
    """
    w = Window.partitionBy(*house)
    n, total, share = F.count("*").over(w), F.sum(weight).over(w), F.col(weight).cast("double")
    near = lambda x: F.floor(F.greatest(share * x / F.col("_w") + 0.5, F.lit(0.0))).cast("long")
    rows = parties.withColumns({"_n": n, "_w": total.cast("double"), "_seats": seats.cast("long")})
    sure, able = near(F.col("_seats") - F.col("_n") / 2), near(F.col("_seats") + F.col("_n") / 2)
    rows = rows.withColumns({"_sure": F.when(F.col("_w") > 0, sure).otherwise(0), "_able": F.when(F.col("_w") > 0, able).otherwise(0)})
    rows = rows.withColumn("_open", F.col("_seats") - F.sum("_sure").over(w))
    more = rows.filter(F.col("_able") > F.col("_sure")).select(
        *house, party, "_open", F.explode(F.sequence(F.col("_sure") + 1, F.col("_able"))).alias("_s"), share.alias("_x")
    )
    rank = F.row_number().over(Window.partitionBy(*house).orderBy((F.col("_x") / (2 * F.col("_s") - 1)).desc(), party, "_s"))
    more = more.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_open")).groupBy(*house, party).agg(F.count("*").alias("_more"))
    rows = rows.join(more, [*house, party], "left")
    return rows.withColumn("quota", F.col("_sure") + F.coalesce("_more", F.lit(0))).drop("_n", "_w", "_seats", "_sure", "_able", "_open", "_more")


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Column | None = None,
    block: int = BLOCK, epochs: int = EPOCHS, shard_rows: int = SHARD_ROWS, seed: str = SEED, keep: list[Column] | None = None,
) -> DataFrame:
    """Per document: id, size, source_size, target, taken, and the columns ``keep``.

    ``weights`` is an expression over ``place``, the source's position by code point (from 1, null last).
    """
    weights = (F.col("place") - 1) % 3 + 1 if weights is None else weights
    src = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("~"))  # after every "=..."
    ident = F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"), F.md5(no_text(text).cast("binary")))
    kept = [c.alias(f"_keep{i}") for i, c in enumerate(keep or [])]
    rows = stage(
        docs.select(F.col(id).alias("id"), src.alias("src"), F.size(words(no_text(text))).cast("long").alias("size"),
                    hash60(F.concat(ident, F.lit(seed))).alias("at"), *kept),
        "sizes",
    )
    sources = rows.groupBy("src").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = sources.withColumn("place", F.row_number().over(Window.orderBy("src"))).withColumn("weight", weights)
    sources = with_targets(sources, epochs).withColumn("all_words", F.sum("words").over(Window.partitionBy()))
    sources = apportion(sources.withColumn("house", F.lit(0)), ["house"], "src", "target", F.round(F.col("all_words") / block))
    sources = stage(
        sources.select("src", "words", "target", F.col("quota").alias("blocks"), F.ceil(F.col("n") / shard_rows).cast("long").alias("shards")),
        "sources",
    )
    dealt = rows.join(sources, "src").withColumn("shard", F.pmod("at", "shards"))
    shards = dealt.groupBy("src", "shard").agg(F.sum("size").alias("shard_words"), F.first("blocks").alias("blocks"))
    shards = apportion(shards, ["src"], "shard", "shard_words", F.col("blocks"))
    n = F.ceil(F.col("shard_words") / block).cast("long")
    start = F.pmod(hash60(F.concat_ws(":", F.lit(seed), "src", F.col("shard").cast("string"))), F.greatest(n, F.lit(1)))
    quota = F.least("quota", epochs * n)
    shards = stage(
        shards.select("src", "shard", n.alias("n"), start.alias("start"), quota.alias("quota")), "quotas"
    )
    line = Window.partitionBy("src", "shard").orderBy("at", "id", "size")
    end = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.join(shards, ["src", "shard"]).withColumn("end", end).withColumn("begin", F.col("end") - F.col("size"))
    rounds = F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0)
    placed = placed.withColumn("rounds", rounds.cast("long")).withColumn("rest", F.col("quota") - F.col("rounds") * F.col("n"))
    common = lambda a, b: F.greatest(F.least("end", b) - F.greatest("begin", a), F.lit(0))
    a, b, all_of_it = F.col("start") * block, (F.col("start") + F.col("rest")) * block, F.col("n") * block
    taken = F.col("rounds") * F.col("size") + common(a, F.least(b, all_of_it)) + common(F.lit(0), b - all_of_it)
    return placed.select(
        F.col("id").alias(id), "size", F.col("words").alias("source_size"), "target", taken.cast("long").alias("taken"),
        *[F.col(f"_keep{i}") for i in range(len(kept))],
    )


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: whole rounds, and once more if half of it or more is taken."""
    taken = mix(docs, id, text, source, keep=[F.struct("*")], **settings)
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest("size", F.lit(1))))
    rows = taken.withColumn("_times", F.when(F.col("size") > 0, times).otherwise(0).cast("int"))
    return rows.filter("_times > 0").withColumn("_round", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_keep0.*")


#: The rows of the mix over a table {docs}; {h} turns an MD5 into the 60-bit number.
MIX_SQL = r"""
md AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '~') AS src,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || 'mix')[1:15])::BIGINT AS pos FROM {docs}),
s1 AS (SELECT src, sum(size)::BIGINT AS words, count(*) AS n, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS weight FROM md GROUP BY src),
s2 AS (SELECT *, 3 * words AS cap, sum(words) OVER ()::BIGINT AS t,
    sum(words) OVER () - coalesce(sum(3 * words) OVER b, 0) AS lw, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS lg
    FROM s1 WINDOW b AS (ORDER BY 3 * words / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap / weight <= lw / lg AS is_full FROM s2),
s4 AS (SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE
    weight * (sum(words) OVER () - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE
    / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM s3),
s5 AS (SELECT *, round(t / 32.0)::BIGINT AS seats FROM s4),
q1 AS (SELECT src, target, seats, unnest(range(1, greatest(floor(target * (seats + 100) / t + 2), 1)::BIGINT + 1)) AS s FROM s5 WHERE target > 0),
q2 AS (SELECT src, count(*) AS blocks FROM (SELECT src FROM q1
    QUALIFY row_number() OVER (ORDER BY target / (2 * s - 1) DESC, src, s) <= seats) GROUP BY src),
d1 AS (SELECT md.*, words, target, coalesce(blocks, 0) AS blocks, pos % ceil(n / 1000)::BIGINT AS shard
    FROM md JOIN s5 USING (src) LEFT JOIN q2 USING (src)),
h1 AS (SELECT src, shard, sum(size)::BIGINT AS sw, any_value(blocks) AS blocks FROM d1 GROUP BY 1, 2),
h2 AS (SELECT *, sum(sw) OVER (PARTITION BY src) AS pw FROM h1),
h3 AS (SELECT src, shard, sw, blocks, unnest(range(1, floor(sw * (blocks + 100) / pw + 2)::BIGINT + 1)) AS s FROM h2 WHERE pw > 0 AND sw > 0),
h4 AS (SELECT src, shard, count(*) AS quota FROM (SELECT src, shard FROM h3
    QUALIFY row_number() OVER (PARTITION BY src ORDER BY sw / (2 * s - 1) DESC, shard, s) <= blocks) GROUP BY 1, 2),
h5 AS (SELECT h1.src, h1.shard, ceil(sw / 32)::BIGINT AS n, least(coalesce(quota, 0), 3 * ceil(sw / 32)::BIGINT) AS quota,
    ('0x' || md5('mix:' || h1.src || ':' || h1.shard)[1:15])::BIGINT % greatest(ceil(sw / 32)::BIGINT, 1) AS start
    FROM h1 LEFT JOIN h4 ON h4.src = h1.src AND h4.shard = h1.shard),
l1 AS (SELECT d1.*, n, quota, start, CASE WHEN n > 0 THEN quota // n ELSE 0 END AS rounds,
    sum(size) OVER (PARTITION BY d1.src, d1.shard ORDER BY pos, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e
    FROM d1 JOIN h5 ON h5.src = d1.src AND h5.shard = d1.shard),
l2 AS (SELECT *, e - size AS b, start * 32 AS x, (start + quota - rounds * n) * 32 AS y FROM l1),
mixed AS (SELECT doc_id, size, words AS source_size, target, (rounds * size
    + greatest(least(e, least(y, n * 32)) - greatest(b, x), 0) + greatest(least(e, y - n * 32) - greatest(b, 0), 0))::BIGINT AS taken FROM l2)
"""
SQL = "WITH " + MIX_SQL.replace("{docs}", "documents").strip() + " SELECT * FROM mixed"
