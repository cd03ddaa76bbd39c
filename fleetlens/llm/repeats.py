"""Windows that repeat across documents, found by super-k-mers: shared by the two operators that remove repeats.

A document is a sequence of units (words or bytes), a window ``length`` units in a row. The minimiser of a window is
the least hash of its grams of ``gram`` units, a function of the window's content alone. Consecutive windows with one
minimiser travel together as one run (a super-k-mer).

1. One scan cuts every text into runs: document, start, number of windows, minimiser and a digest of the content.
   Runs that are alone with their minimiser are done.
2. Of the others, runs with equal content combine before the shuffle; the first place is kept of each.
3. A minimiser with one content only has no windows to compare. Of the others each content is packed once, from its
   first place, and goes to its minimiser's bucket, where its windows are sorted; each gets the first place of all.
   A minimiser with more than ``most`` windows is hot: its windows are grouped by Spark instead, content by content.
4. Every run asks for its content's first places; windows with an earlier one cover what is removed.

Ids are integers; a null id comes after all others. Copies of one row (equal id and text) are one document here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, no_text, stage

LAST = (1 << 63) - 1
MOST, BATCH = 1 << 17, 1 << 19
ROWS, PACKED = 1 << 14, 1 << 20
#: Large staged tables take less disk this way.
SMALL = {"compression": "zstd"}

RUNS = "id long, th long, start int, n int, minimiser long, digest long, again boolean"
_RUNS = pa.schema([
    ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("minimiser", pa.int64()),
    ("digest", pa.int64()), ("again", pa.bool_()),
])


@dataclass(frozen=True)
class Units:
    """What a text is made of, and how its windows are compared."""

    length: int
    gram: int
    #: text -> (hash of every gram, content hash of the units [start, end))
    hashes: Callable[[bytes], tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]]
    #: text -> function (start, end) -> packed content of these units
    packer: Callable[[bytes], Callable[[int, int], bytes]]
    #: contents, and the ids and starts of their first places -> for each content the ids and starts of its windows' first places
    solve: Callable[[list[bytes], np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]
    #: content -> its windows as bytes
    windows: Callable[[bytes], Iterator[bytes]]
    #: whether a window may be removed for an earlier place in its own document
    within: bool


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of every w values in a row, by doubling."""
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def runs_of(text: bytes, units: Units) -> tuple[np.ndarray, ...]:
    """start, n, minimiser, digest, again of the runs. ``again``: the minimiser is in the run more than once."""
    grams, content = units.hashes(text)
    w = units.length - units.gram + 1
    if len(grams) < w:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    least = sliding_least(grams, w)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.append(start, len(least)))
    value = least[start]
    first, again = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    for i in range(0, len(start), 4096):
        s, v, m = start[i : i + 4096], value[i : i + 4096, None], n[i : i + 4096]
        near = np.arange(w)
        first[i : i + 4096] = s + (grams[s[:, None] + near] == v).argmax(1)
        end = s + m - 1
        last = end + (w - 1) - (grams[end[:, None] + near[::-1]] == v).argmax(1)
        again[i : i + 4096] = last > first[i : i + 4096]
    digest = content(start, start + n - 1 + units.length)
    return start, n, value.view(np.int64), digest.view(np.int64), again


def _keys(docs: DataFrame, id: str, text: str) -> tuple[Column, Column]:
    """A document's id, and what tells documents of equal id apart: the hash of the text, 0 where no id repeats."""
    number = F.coalesce(F.col(id).cast("long"), F.lit(LAST))
    repeated = docs.groupBy(number.alias("id")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return number, F.xxhash64(no_text(text).cast("binary")) if repeated > 1 else F.lit(0).cast("long")


def _runs(texts: DataFrame, units: Units) -> DataFrame:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        ids, ths, *found = zip(*rows)
        n = [len(x) for x in found[0]]
        columns = [np.repeat(np.array(x, np.int64), n) for x in (ids, ths)] + [np.concatenate(x) for x in found]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(f.type.to_pandas_dtype(), copy=False)) for x, f in zip(columns, _RUNS)], schema=_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for id, th, text in zip(*(c for c in batch.columns)):
                found = runs_of(text.as_py(), units)
                if len(found[0]):
                    rows.append((id.as_py(), th.as_py(), *found))
                    held += len(found[0])
                if held >= ROWS:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    return arrow_map(texts, run, RUNS)


def _packed(texts: DataFrame, wanted: DataFrame, units: Units) -> DataFrame:
    """The contents of the wanted runs (id, th, start, n, minimiser, digest, hot), each from its first place."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n", "minimiser", "digest", "hot")).alias("runs"))
    rows = texts.join(lists, ["id", "th"]).select("id", "text", "runs")
    schema = pa.schema([("minimiser", pa.int64()), ("digest", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("hot", pa.bool_()), ("content", pa.binary())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            lists = batch.column(2)
            fields = {f: lists.flatten().field(f).to_pylist() for f in ("start", "n", "minimiser", "digest", "hot")}
            at = 0
            for id, text, size in zip(batch.column(0).to_pylist(), batch.column(1), lists.value_lengths().to_pylist()):
                pack = units.packer(text.as_py())
                for i in range(at, at + size):
                    start = fields["start"][i]
                    content = pack(start, start + fields["n"][i] - 1 + units.length)
                    found.append((fields["minimiser"][i], fields["digest"][i], id, start, fields["hot"][i], content))
                    held += len(content)
                    if held >= PACKED:
                        yield out(found)
                        found, held = [], 0
                at += size
        if found:
            yield out(found)

    out = arrow_map(rows, run, "minimiser long, digest long, id long, start int, hot boolean, content binary")
    return out.dropDuplicates(["minimiser", "digest"])


FIRSTS = "minimiser long, digest long, ids array<long>, starts array<int>"
_FIRSTS = pa.schema([("minimiser", pa.int64()), ("digest", pa.int64()), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))])


def _solved(packed: DataFrame, units: Units) -> DataFrame:
    """First places of the windows of the contents of minimisers that are not hot, bucket by bucket."""

    def answer(rows: list) -> pa.RecordBatch:
        keys, digests, ids, starts, contents = zip(*rows)
        places = units.solve(list(contents), np.array(ids, np.int64), np.array(starts, np.int64))
        columns = [pa.array(keys, pa.int64()), pa.array(digests, pa.int64())]
        columns += [pa.array([p[i] for p in places], f.type) for i, f in enumerate((_FIRSTS.field(2), _FIRSTS.field(3)))]
        return pa.RecordBatch.from_arrays(columns, schema=_FIRSTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= BATCH and row[0] != rows[-1][0]:  # whole minimisers only
                    yield answer(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield answer(rows)

    bucketed = packed.select("minimiser", "digest", "id", "start", "content").repartition("minimiser").sortWithinPartitions("minimiser")
    return arrow_map(bucketed, run, FIRSTS)


def _grouped(packed: DataFrame, units: Units) -> DataFrame:
    """The same for hot minimisers: one row a window, whose first place Spark finds with map-side combining."""
    schema = pa.schema([("minimiser", pa.int64()), ("digest", pa.int64()), ("i", pa.int32()), ("id", pa.int64()), ("start", pa.int32()), ("window", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, d, id, start, content in zip(*batch.columns):
                m, d, id, start = m.as_py(), d.as_py(), id.as_py(), start.as_py()
                windows, a = units.windows(content.as_py()), 0
                while part := list(islice(windows, 4096)):
                    at, k = range(a, a + len(part)), len(part)
                    a += k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m] * k, pa.int64()), pa.array([d] * k, pa.int64()), pa.array(at, pa.int32()), pa.array([id] * k, pa.int64()),
                         pa.array([start + i for i in at], pa.int32()), pa.array(part, pa.binary())], schema=schema)

    source = packed.select("minimiser", "digest", "id", "start", "content")
    rows = arrow_map(source, run, "minimiser long, digest long, i int, id long, start int, window binary")
    rows = stage(rows.withColumn("window", F.md5("window")), "hot-windows", **SMALL)
    # stored, so that the join deals its rows out anew and Spark can split a window that most contents have
    first = stage(rows.groupBy("window").agg(F.min(F.struct("id", "start")).alias("first")), "window-places")
    placed = rows.select("minimiser", "digest", "i", "window").join(first, "window")
    lists = placed.groupBy("minimiser", "digest").agg(F.array_sort(F.collect_list(F.struct("i", "first"))).alias("x"))
    return lists.select("minimiser", "digest", F.col("x.first.id").alias("ids"), F.col("x.first.start").alias("starts"))


def _hits(asked: DataFrame, within: bool) -> DataFrame:
    """Stretches of windows with an earlier first place: id, th, first, last + 1.

    Where a content is alone under its minimiser, only its own first place is given, and its windows follow from there.
    """

    def stretches(batch: pa.RecordBatch) -> pa.RecordBatch:
        id, th, start, n = (np.asarray(batch.column(i)) for i in range(4))
        sizes = np.asarray(batch.column(4).value_lengths()).astype(np.int64)
        ids, starts = np.asarray(batch.column(4).flatten()), np.asarray(batch.column(5).flatten())
        row = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        listed = (sizes == n)[row]
        at = (np.cumsum(sizes) - sizes)[row] + np.where(listed, j, 0)
        hit = ids[at] < id[row]
        if within:
            hit |= (ids[at] == id[row]) & (starts[at] + np.where(listed, 0, j) < start[row] + j)
        step = np.diff(np.concatenate([[False], hit]).astype(np.int8))
        opens = hit & ((step == 1) | (j == 0))
        closes = hit & (np.append(step[1:] == -1, True) | (j == n[row] - 1))
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        places = (start[row] + j).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (id[row[a]], th[row[a]], places[a], places[b] + np.int32(1))], ["id", "th", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                yield stretches(batch.slice(i, 4096))

    return arrow_map(asked, run, "id long, th long, a int, b int")


def removed_windows(texts: DataFrame, units: Units, most: int = MOST) -> DataFrame:
    """Per document (id, th) of the texts (id, th, text) its ``spans`` of removed windows: first, last + 1."""
    cut = stage(_runs(texts, units), "runs", **SMALL)
    # a minimiser of one run says nothing: most of a clean corpus ends here, after a shuffle of one number a run
    shared = cut.groupBy("minimiser").agg(F.count("*").alias("runs"), F.max("again").alias("again"))
    shared = shared.filter((F.col("runs") > 1) | (F.col("again") if units.within else F.lit(False))).select("minimiser")
    runs = stage(cut.join(stage(shared, "shared-minimisers").hint("shuffle_hash"), "minimiser", "left_semi"), "shared-runs", **SMALL)
    place = F.struct("id", "start", "th", "n")
    contents = runs.groupBy("minimiser", "digest").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.max("again").alias("again"))
    contents = contents.select(
        "minimiser", "digest", "again", "p.id", "p.start", "p.th", "p.n",
        (F.col("q.id") != F.col("p.id") if not units.within else F.struct("q.id", "q.start") != F.struct("p.id", "p.start")).alias("repeated"),
    )
    counted = contents.groupBy("minimiser").agg(
        F.count("*").alias("contents"), F.max("repeated").alias("any"), F.max("again").alias("inside"),
        F.sum("n").alias("windows"),
    )
    several = (F.col("contents") > 1) | (F.col("inside") if units.within else F.lit(False))
    counted = counted.filter(several | F.col("any")).select("minimiser", several.alias("several"), (F.col("windows") > most).alias("hot"))
    chosen = stage(contents.join(counted, "minimiser"), "contents", **SMALL)
    packed = stage(_packed(texts, chosen.filter("several"), units), "packed", **SMALL)
    solved = _solved(packed.filter("not hot"), units).unionByName(_grouped(packed.filter("hot"), units))
    alone = chosen.filter("not several").select(
        "minimiser", "digest", F.array("id").alias("ids"), F.array("start").alias("starts")
    )
    firsts = stage(solved.unionByName(alone), "first-places", **SMALL)
    asked = runs.select("id", "th", "start", "n", "minimiser", "digest").join(firsts, ["minimiser", "digest"])
    hits = _hits(asked.select("id", "th", "start", "n", "ids", "starts"), units.within)
    spans = hits.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return stage(spans, "spans")


def covered(spans: list, length: int) -> list[tuple[int, int]]:
    """Maximal covered stretches of the windows that start in the spans (pairs first, last + 1)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = b - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, keep: list[Column], units: Units, id: str, text: str, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, ``_text`` (bytes) and ``_spans``, null where nothing goes."""
    number, hashed = _keys(docs, id, text)
    body = no_text(text).cast("binary")
    spans = removed_windows(docs.select(number.alias("id"), hashed.alias("th"), body.alias("text")), units, most)
    rows = docs.select(*keep, body.alias("_text"), number.alias("_i"), hashed.alias("_h"))
    spans = spans.select(F.col("id").alias("_i"), F.col("th").alias("_h"), F.col("spans").alias("_spans"))
    return rows.join(spans, ["_i", "_h"], "left").drop("_i", "_h")
