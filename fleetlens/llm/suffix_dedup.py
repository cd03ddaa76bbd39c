"""Suffix-array dedup: bytes that a repeated string of 100 bytes covers go, but for its first place.

Only content that can repeat is sorted: strings whose windows share a minimiser (least hash of 24 bytes) with other
content, cut and packed as in :mod:`fleetlens.llm.repeats`. Each bucket of them is one suffix array by two-stage
sorting: suffixes smaller than their successors are sorted directly, to the depth of a window; one scan over the buckets
of first bytes places all others before their successors. Neighbours whose common prefix is a whole window are equal
strings, and the first place of each group counts.

Texts are UTF-8, so a byte + 1 fits a byte and 0 is free to end a content. Order to the depth of a window is all that
is needed: two suffixes that differ within it differ there or, after one equal byte, in successors that are in order.

Defined cases: null and empty texts, and texts shorter than a window, lose nothing; null ids come after all others;
repeated rows are one document and each get a row back; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map
from fleetlens.llm.repeats import Units, covered, with_spans
from fleetlens.llm.shingles import content_hashes, gram_hashes

WINDOW, GRAM = 100, 24
#: Windows of one minimiser that one suffix array takes (about 350 MB of a task's memory); beyond, Spark groups them.
MOST = 1 << 20


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of bytes that end in 0, in their order to ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    step = np.diff(text.astype(np.int16))
    # whether a suffix is smaller than its successor: told by the next byte that differs; the last one is not
    differs = np.flatnonzero(step)
    after = np.searchsorted(differs, np.arange(n))
    rises = np.append(step[differs] > 0, False)
    smaller = rises[np.minimum(after, len(differs))]
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    direct = np.flatnonzero(smaller)
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct].copy().view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    # in a bucket of one first byte, those smaller than their successors come last
    sizes = np.bincount(text, minlength=256)
    heads = np.cumsum(sizes) - sizes
    of_direct = np.bincount(text[direct], minlength=256)
    sa = np.full(n, -1, np.int64)
    within = np.arange(len(direct)) - np.repeat(np.cumsum(of_direct) - of_direct, of_direct)
    sa[np.repeat(heads + sizes - of_direct, of_direct) + within] = direct
    if n:
        induce(sa, heads, text, smaller, heads + sizes - of_direct)
    return sa


def induce(sa: np.ndarray, heads: np.ndarray, text: np.ndarray, smaller: np.ndarray, direct: np.ndarray) -> None:
    """Fills in the suffixes that are not smaller than their successors, bucket by bucket of first bytes.

    ``direct`` is where each bucket's directly sorted part begins. Every suffix of a bucket, in order, places the one
    before it behind what its own bucket has; those of the same bucket are taken in turn before its direct part.
    """
    fill = heads.copy()
    last = len(text) - 1
    sa[fill[text[last]]] = last
    fill[text[last]] += 1

    def place(found: np.ndarray, bucket: int) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        same = before[first == bucket]
        if len(same):
            sa[fill[bucket] : fill[bucket] + len(same)] = same
            fill[bucket] += len(same)
        other = first != bucket
        before, first = before[other], first[other]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            counts = np.bincount(first, minlength=256)
            sa[fill[first] + np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)[: len(first)]] = before
            fill[:256] += counts

    ends = np.append(heads[1:], len(text))
    for bucket in np.flatnonzero(ends > heads).tolist():
        done = heads[bucket]
        while done < fill[bucket]:
            upto = fill[bucket]
            place(sa[done:upto], bucket)
            done = upto
        place(sa[direct[bucket] : ends[bucket]], bucket)


def _solve(length: int) -> Callable:
    def solve(contents: list[bytes], ids: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        text = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8) + np.uint8(1)  # the end of a content becomes 0
        sizes = np.array([len(c) + 1 for c in contents])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(contents)), sizes)
        offset = np.arange(len(text)) - begin[owner]
        whole = offset <= (sizes - 1 - length)[owner]
        sa = suffix_array(text, length)
        sa = sa[whole[sa]]
        view = np.lib.stride_tricks.sliding_window_view(text, length)
        group = np.zeros(len(sa), np.int64)
        for a in range(1, len(sa), 65536):
            here = slice(a, min(a + 65536, len(sa)))
            differ = view[sa[a - 1 : here.stop - 1]] != view[sa[here]]
            common = np.where(differ.any(1), differ.argmax(1), length)  # adjacent common prefixes
            group[here] = common < length
        group = np.cumsum(group)
        id, start = ids[owner[sa]], starts[owner[sa]] + offset[sa]
        by_place = np.lexsort((start, id, group))
        first = by_place[np.concatenate([[True], np.diff(group) > 0])[: len(sa)]]  # groups are ascending
        least_id, least_start = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        least_id[sa], least_start[sa] = id[first][group], start[first][group]
        return [
            (least_id[b : b + max(m - length, 0)], least_start[b : b + max(m - length, 0)].astype(np.int32)) for b, m in zip(begin, sizes)
        ]

    return solve


def _hashes(gram: int) -> Callable:
    def hashes(text: bytes) -> tuple:
        return gram_hashes(text, gram), content_hashes(np.frombuffer(text, np.uint8))

    return hashes


def byte_units(length: int = WINDOW, gram: int = GRAM) -> Units:
    return Units(
        length, gram, _hashes(gram), lambda text: lambda a, b: text[a:b], _solve(length),
        lambda c: (c[i : i + length] for i in range(len(c) - length + 1)), within=True,
    )


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept (the remaining bytes: a cut may part a character)."""
    rows = with_spans(docs, [F.col(id).alias("_id")], byte_units(length, gram), id, text, most).select("_id", "_text", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, out = batch.slice(i, 64), []
                for text, spans in zip(part.column(1), part.column(2)):
                    text, kept, at = text.as_py(), [], 0
                    gone = covered([(s["a"], s["b"]) for s in spans.as_py() or ()], length)
                    for a, b in gone:
                        kept.append(text[at:a])
                        at = b
                    kept = b"".join([*kept, text[at:]])
                    out.append((len(text), len(text) - len(kept), len(gone), kept))
                columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = rows.schema["_id"].dataType.simpleString()
    return arrow_map(rows, run, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("_id", id)


def repeats_report(docs: DataFrame, id: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs, id, text, **settings).select(id, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
