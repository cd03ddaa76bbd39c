"""Substring dedup by super-k-mer partitioning: words of windows that an earlier document has go.

Windows are 50 consecutive words; consecutive windows with one minimiser (least hash of 8 words) travel as one packed
string, see :mod:`fleetlens.llm.repeats`. In its bucket every window is written out and sorted with its place, so equal
windows are counted exactly.

Defined cases: null and empty texts, and texts of fewer words than a window, lose nothing; null ids come after all
others; documents of equal id do not take from each other; repeated rows each get a row back; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD, arrow_map
from fleetlens.llm.repeats import Units, covered, with_spans
from fleetlens.llm.shingles import content_hashes, window_hashes, word_hashes

WINDOW, GRAM = 50, 8


def _hashes(gram: int) -> Callable:
    def hashes(text: bytes) -> tuple:
        words = word_hashes(text)
        return window_hashes(words, gram), content_hashes(words)

    return hashes


def _packer(text: bytes) -> Callable[[int, int], bytes]:
    words = WORD.findall(text)
    return lambda a, b: b" ".join(words[a:b])


def _windows(length: int) -> Callable[[bytes], Iterator[bytes]]:
    def windows(content: bytes) -> Iterator[bytes]:
        words = content.split(b" ")
        return (b" ".join(words[i : i + length]) for i in range(len(words) - length + 1))

    return windows


def _solve(length: int) -> Callable:
    windows = _windows(length)

    def solve(contents: list[bytes], ids: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        rows = sorted((w, id, start + i, k, i) for k, (c, id, start) in enumerate(zip(contents, ids.tolist(), starts.tolist())) for i, w in enumerate(windows(c)))
        n = np.bincount([r[3] for r in rows], minlength=len(contents))
        out = [(np.zeros(m, np.int64), np.zeros(m, np.int32)) for m in n]
        last = None
        for row in rows:
            if last is None or row[0] != last[0]:
                last = row
            out[row[3]][0][row[4]], out[row[3]][1][row[4]] = last[1], last[2]
        return out

    return solve


def word_units(length: int = WINDOW, gram: int = GRAM) -> Units:
    return Units(length, gram, _hashes(gram), _packer, _solve(length), _windows(length), within=False)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = WINDOW, gram: int = GRAM, **limits: int) -> DataFrame:
    """Per document: id, n_words, n_removed, kept (its text without the removed words, joined by blanks)."""
    rows = with_spans(docs, [F.col(id).alias("_id")], word_units(length, gram), id, text, **limits).select("_id", "_text", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, out = batch.slice(i, 64), []
                for text, spans in zip(part.column(1), part.column(2)):
                    words, kept, at = WORD.findall(text.as_py()), [], 0
                    for a, b in covered([(s["a"], s["b"]) for s in spans.as_py() or ()], length):
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
                n, gone, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["_id", "n_words", "n_removed", "kept"]
                )

    kind = rows.schema["_id"].dataType.simpleString()
    return arrow_map(rows, run, f"_id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("_id", id)


def repeats_report(docs: DataFrame, id: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256."""
    return without_repeats(docs, id, text, **settings).select(id, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: A window is told by the MD5 of its words; which words go follows from the places of the removed windows.
SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
gone AS MATERIALIZED (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
pos AS (SELECT DISTINCT doc_id, i + k AS i FROM gone, range(50) r(k)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN pos USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
