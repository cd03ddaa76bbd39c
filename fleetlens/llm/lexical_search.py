"""Ranked lexical search by bags: documents that an item's vocabulary cannot tell apart are scored once.

1. Items are dealt into blocks of about ``ITEMS``. The terms of a block are its vocabulary, a table whose size the items
   bound; one scan restricts every whole text to it: the bag of a document is its (term, tf) vector, packed.
2. The number of documents, their terms, and the documents of every term are counted over all texts.
3. Documents of equal bag and equal m are one class: their hash leads the grouping, the whole bag and m verify it.
   Classes are scored for all items of a block at once along the items' postings, each task keeping the best per item.
   A class ranks by its least id, so the best ``k`` classes of an item hold its best ``k`` documents.
4. Of the chosen classes only, members are found by hash, verified by bag, and listed by ascending id, ``k`` of each.

No pairs of documents and items are written, and a class of any size gives ``k`` rows to an item at most.

Defined cases: a null text has no terms; it and a text without an item's term are never listed; items without terms give
no rows; equal rows of items are one item; items of equal id and other text are ranked apart; repeated documents are
documents of their own and are each listed; null ids come after all others; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, no_text, stage

K, ITEMS, PART, LAST = 10, 256, 1024, (1 << 63) - 1

#: Bytes of terms as themselves, A-Z as a-z, all others as blanks.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z in lower case."""
    return text.translate(_FOLD).split()


class ItemIndex:
    """The vocabulary of a block of items, and for every term the items that hold it and how often."""

    def __init__(self, texts: list[bytes]) -> None:
        held = [Counter(terms_of(t)) for t in texts]
        self.items = len(texts)
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*held)))}
        rows = sorted((self.vocabulary[t], item, n) for item, counts in enumerate(held) for t, n in counts.items())
        term, self.item, self.times = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.begin = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.longest = max((sum(c.values()) for c in held), default=0)
        self.weight = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        for t in self.vocabulary.values():
            self.weight[t] = floor(1000 * log((2 * documents + 2) / (2 * df.get(t, 0) + 1)))

    def scores(self, bags: list[bytes], m: np.ndarray) -> np.ndarray:
        """Score of every bag for every item."""
        sizes = np.array([len(b) // 8 for b in bags])
        pairs = np.frombuffer(b"".join(bags), np.int32).reshape(-1, 2).astype(np.int64)
        term, tf, row = pairs[:, 0], pairs[:, 1], np.repeat(np.arange(len(bags)), sizes)
        part = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        n = self.begin[term + 1] - self.begin[term]
        each = np.repeat(np.arange(len(term)), n)
        at = self.begin[term][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        cell, value, size = row[each] * self.items + self.item[at], part[each] * self.times[at], len(bags) * self.items
        if int(self.weight.max(initial=0)) * 1_000_000 * self.longest < 1 << 53:  # sums of doubles are exact
            out = np.bincount(cell, weights=value, minlength=size).astype(np.int64)
        else:
            out = np.zeros(size, np.int64)
            np.add.at(out, cell, value)
        return out.reshape(len(bags), self.items)


def bags(docs: DataFrame, id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document: id, n (terms with repeats) and its bag, null where it holds no term of the vocabulary."""
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("id"), no_text(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, packed = [], []
            for value in batch.column(1):
                terms = terms_of(value.as_py())
                counts = Counter(terms)
                held = sorted((vocabulary[t], counts[t]) for t in counts if t in vocabulary)
                sizes.append(len(terms))
                packed.append(np.array(held, np.int32).tobytes() if held else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["id", "n", "bag"])

    return arrow_map(rows, run, "id long, n long, bag binary")


def document_frequencies(found: DataFrame, terms: int) -> dict[int, int]:
    """Documents per term: counted in every task, then summed; one number a term comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(b.as_py() for b in batch.column(0)), np.int32)[::2]
            total += np.bincount(held, minlength=terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "df"])

    parts = arrow_map(found.select("bag"), run, "term long, df long")
    return {r.term: r.df for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def best_classes(classes: DataFrame, index: ItemIndex, k: int) -> DataFrame:
    """``item, score, least, rid``: the best k classes of every item in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, score, least, rid = (np.zeros(0, np.int64) for _ in range(4))
        floors = np.ones(index.items, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, PART):
                part = batch.slice(i, PART)
                rids, m, lows = (np.asarray(part.column(c)) for c in range(3))
                found = index.scores(part.column(3).to_pylist(), m)
                rows, items = np.nonzero(found >= floors)
                if not len(rows):
                    continue
                item, score = np.concatenate([item, items]), np.concatenate([score, found[rows, items]])
                least, rid = np.concatenate([least, lows[rows]]), np.concatenate([rid, rids[rows]])
                order = np.lexsort((least, -score, item))
                item, score, least, rid = item[order], score[order], least[order], rid[order]
                begin = np.searchsorted(item, np.arange(index.items + 1))
                keep = np.arange(len(item)) - begin[item] < k
                item, score, least, rid = item[keep], score[keep], least[keep], rid[keep]
                full = np.flatnonzero(np.bincount(item, minlength=index.items) == k)
                floors[full] = score[np.searchsorted(item, full, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (item, score, least, rid)], ["item", "score", "least", "rid"])

    best = arrow_map(classes.select("rid", "m", "least", "bag"), run, "item long, score long, least long, rid long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "least", "rid"))
    return best.withColumn("place", rank).filter(F.col("place") <= k).drop("place")


def search_block(docs: DataFrame, texts: list[bytes], k: int, id: str, text: str) -> DataFrame | None:
    """``item`` (place in ``texts``), ``rank``, ``doc_id``, ``score`` of one block of items."""
    index = ItemIndex(texts)
    if not index.vocabulary:
        return None
    found = stage(bags(docs, id, text, index.vocabulary), "bags")
    documents, length = found.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    index.weigh(documents, document_frequencies(found.filter("bag IS NOT NULL"), len(index.vocabulary)))
    m = F.expr(f"25L + ((75L * n * {documents}L) div {length}L)")
    members = found.filter("bag IS NOT NULL").select("id", m.alias("m"), "bag")
    members = members.withColumn("digest", F.unhex(F.md5(F.concat(F.col("m").cast("string").cast("binary"), "bag"))))
    classes = members.groupBy("digest", "m", "bag").agg(F.min("id").alias("least"))
    classes = stage(classes.withColumn("rid", F.monotonically_increasing_id()), "bag-classes")
    chosen = stage(best_classes(classes, index, k), "best-classes")
    # as many rows as items times k at most
    named = stage(classes.join(F.broadcast(chosen.select("rid").distinct()), "rid").select("rid", "digest", "m", "bag"), "chosen-classes")
    near = members.join(F.broadcast(named.select("digest").distinct()), "digest", "left_semi")
    first = F.row_number().over(Window.partitionBy("digest", "m", "bag").orderBy("id"))
    near = near.withColumn("place", first).filter(F.col("place") <= k).drop("place")
    rows = near.join(named, ["digest", "m", "bag"]).select("rid", "id").join(chosen.select("rid", "item", "score"), "rid")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= k)
    return rows.select("item", "rank", F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = K, id: str = "doc_id", text: str = "text", item: str = "item_id", block: int = ITEMS
) -> DataFrame:
    """Per item its k best documents with a score above 0: item_id, rank from 1, doc_id, score."""
    spark = docs.sparkSession
    asked = stage(items.select(F.col(item).alias("item_id"), no_text(text).cast("binary").alias("text")).distinct(), "items")
    blocks = max(1, -(-asked.count() // block))
    kind = asked.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if not rows or (found := search_block(docs, [bytes(r.text) for r in rows], k, id, text)) is None:
            continue
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {kind}")
        out = out.union(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return out


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS len FROM d WHERE len(ws) > 0),
q AS MATERIALIZED (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM d)
    WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t),
p AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs) // len)))) AS x FROM tf JOIN w USING (t), s),
r AS (SELECT item_id, doc_id, sum(times * x)::BIGINT AS score FROM q JOIN p USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
