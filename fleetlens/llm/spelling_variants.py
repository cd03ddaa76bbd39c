"""Groups spelling variants: words one edit apart, found by an index of variable-length grams.

1. Words and how often they occur are counted over all whole texts; counts combine in every task before the shuffle.
2. The gram dictionary grows level by level over all words, from ``QMIN`` to ``QMAX`` symbols (a word is framed by a
   begin and an end symbol). A gram of more than ``threshold`` places is frequent and is kept, to be made longer; one
   level has at most places / threshold of them, which bounds the dictionary that tasks get.
3. A word's grams: from every place the shortest gram that is rare, and the shortest rare one that ends the word. A gram
   depends on its own symbols alone, so an edit affects those that cover its place and no others. The most that any
   place has is the word's affected-gram bound: near words share all but that many. So a word is listed under its
   bound + 1 first grams in one order of all grams; a near word is in one of these lists. A list has ``threshold``
   words at most, whatever the corpus.
4. Where all grams of a word may be affected at once (short words, or junk whose grams are all frequent), the word is
   listed under itself with each symbol left out as well: two such near words share one of these. That list is bounded
   by alphabet and length.
5. Lists are merged in numpy: lengths and sets of letters first, then equal beginnings and ends verify one edit.

Defined cases: null and empty texts have no words; a null id hashes as an empty one; repeated rows count again; an empty
table gives an empty one; other columns are not read; words of any length are compared whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, no_text, stage
from fleetlens.llm.shingles import mixed

LEAST_LENGTH, LEAST_COUNT, RATIO, EVERY = 7, 2, 10, 31
QMIN, QMAX, PLACES, NODES = 4, 8, 256, 1 << 21
FLUSH, ROWS, WIDE = 1 << 18, 1 << 16, 32

#: Letters are Latin-1: A-Z as a-z, other letters of the class as themselves, all else as blanks.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))
_BEGIN, _END, _GAP = b"\x01", b"\x02", b"\x00" * (QMAX - 1)


def runs_of(text: str) -> list[bytes]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` as Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def shortened(run: bytes, h: int) -> bytes:
    return run if h % EVERY else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``word`` (Latin-1), ``n`` of the words of all texts."""
    rows = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), no_text(text).alias("text"))

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for id, text in zip(batch.column(0), batch.column(1)):
                begun = crc32(f"{id.as_py()}:".encode())
                for r, n in Counter([r for r in runs_of(text.as_py()) if len(r) >= LEAST_LENGTH]).items():
                    h = crc32(r if r.isascii() else r.decode("latin-1").encode(), begun)
                    if h % EVERY == 0:
                        r = shortened(r, h)
                        if len(r) < LEAST_LENGTH:
                            continue
                    total[r] += n
                if len(total) >= FLUSH:
                    yield out(total)
                    total = Counter()
        yield out(total)

    counted = arrow_map(rows, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


class Framed:
    """Framed words side by side: of every place of a symbol, the ``QMAX`` symbols from there as one number."""

    def __init__(self, words: list[bytes]) -> None:
        self.length = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join([_BEGIN + w + _END + _GAP for w in words]) + _GAP, np.uint8)
        self.size = self.length + 2 + len(_GAP)
        self.first = np.cumsum(self.size) - self.size
        self.flat = flat
        code = np.zeros(len(flat) - len(_GAP), np.uint64)
        for k in range(QMAX):
            code = (code << np.uint64(8)) | flat[k : k + len(code)]
        self.code = code
        # a gram of QMIN symbols fits from here: places 0 .. length + 2 - QMIN of every word
        n = np.maximum(self.length + 3 - QMIN, 0)
        self.owner = np.repeat(np.arange(len(words)), n)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(n) - n, n)
        self.at = self.first[self.owner] + self.place

    def room(self) -> np.ndarray:
        """Symbols from every place to the end symbol, with it."""
        return self.length[self.owner] + 2 - self.place


def prefix(code: np.ndarray, q: int) -> np.ndarray:
    return code & np.uint64(((1 << 8 * q) - 1) << 8 * (QMAX - q))


def held(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values the sorted table has."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def gram_dictionary(words: DataFrame, threshold: int) -> dict[int, np.ndarray]:
    """Frequent grams by length, sorted. ``words`` is a stored table."""
    tables: dict[int, np.ndarray] = {}
    for q in range(QMIN, QMAX + 1):

        def run(batches: Iterator[pa.RecordBatch], q: int = q) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0

            def out() -> pa.RecordBatch:
                grams, n = np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])

            for batch in batches:
                framed = Framed(batch.column(0).to_pylist())
                codes = framed.code[framed.at][framed.room() >= q]
                if q > QMIN:
                    codes = codes[held(prefix(codes, q - 1), tables[q - 1])]
                parts.append(prefix(codes, q))
                size += len(codes)
                if size >= 1 << 21:
                    yield out()
                    parts, size = [], 0
            yield out()

        counted = arrow_map(words.select("word"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        found = counted.filter(F.col("n") > threshold).select("gram").toPandas()["gram"].to_numpy(np.int64)
        tables[q] = np.sort(found.view(np.uint64))
        if not len(tables[q]):
            tables |= {later: tables[q] for later in range(q + 1, QMAX + 1)}
            break
    return tables


def grams_of(words: list[bytes], tables: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The variable grams of the words: owner, first place, size, code; and of every word its affected-gram bound."""
    framed = Framed(words)
    code, room = framed.code[framed.at], framed.room()
    size = np.zeros(len(code), np.int64)  # 0: no rare gram without the end symbol
    open_ = room > QMIN
    for q in range(QMIN, QMAX + 1):
        here = np.flatnonzero(open_ & (room > q))
        rare = ~held(prefix(code[here], q), tables[q])
        size[here[rare]] = q
        open_[here[rare]] = False
        open_ &= room > q
    inner = np.flatnonzero(size)
    owner, place, size, code = framed.owner[inner], framed.place[inner], size[inner], code[inner]
    code = np.where(size < QMAX, code & ~((np.uint64(1) << (8 * (QMAX - size)).astype(np.uint64)) - np.uint64(1)), code)
    # the shortest rare gram with the end symbol
    last, waiting = np.zeros(len(words), np.int64), np.ones(len(words), bool)
    for q in range(QMIN, QMAX + 1):
        here = np.flatnonzero(waiting & (framed.length + 2 >= q))
        tail = prefix(framed.code[framed.first[here] + framed.length[here] + 2 - q], q)
        rare = ~held(tail, tables[q])
        last[here[rare]] = q
        waiting[here[rare]] = False
    ends = np.flatnonzero(last)
    begin = framed.length[ends] + 2 - last[ends]
    owner, place, size = np.concatenate([owner, ends]), np.concatenate([place, begin]), np.concatenate([size, last[ends]])
    code = np.concatenate([code, framed.code[framed.first[ends] + begin]])
    cover = np.zeros(len(framed.flat) + 1, np.int64)
    np.add.at(cover, framed.first[owner] + place, 1)
    np.add.at(cover, framed.first[owner] + place + size, -1)
    bound = np.maximum.reduceat(np.cumsum(cover), framed.first) if len(words) else np.zeros(0, np.int64)
    return owner, place, size, code, bound


def postings(words: DataFrame, tables: dict[int, np.ndarray]) -> DataFrame:
    """``token, word, n``: the lists that every word is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                part = batch.slice(i, 8192)
                found = part.column(0).to_pylist()
                owner, _, _, code, bound = grams_of(found, tables)
                # equal grams of a word are told apart by their number
                order = np.lexsort((code, owner))
                owner, code = owner[order], code[order]
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])[: len(owner)]
                start = np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
                token = mixed(code + (np.arange(len(owner)) - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.lexsort((token, owner))
                owner, token = owner[order], token[order]
                total = np.bincount(owner, minlength=len(found))
                begin = np.cumsum(total) - total
                keep = np.arange(len(owner)) - begin[owner] <= bound[owner]
                owner, token = owner[keep], token[keep].view(np.int64)
                spare, keys = [], []
                for j in np.flatnonzero(bound >= total).tolist():
                    w = found[j]
                    forms = {w, *(w[:p] + w[p + 1 :] for p in range(len(w)))}
                    spare += [j] * len(forms)
                    keys += [int.from_bytes(blake2b(f, digest_size=8).digest(), "little", signed=True) for f in forms]
                owner = np.concatenate([owner, np.array(spare, np.int64)])
                token = np.concatenate([token, np.array(keys, np.int64)])
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(token), part.column(0).take(rows), part.column(1).take(rows)], ["token", "word", "n"])

    return arrow_map(words.select("word", "n"), run, "token long, word binary, n long")


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether the words differ by one inserted, deleted or replaced symbol."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_pairs(token: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words within the lists; ``token`` is sorted."""
    n = len(words)
    length = np.array([len(w) for w in words], np.int64)
    wide = np.minimum(length, WIDE)
    row = np.repeat(np.arange(n), wide)
    column = np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)
    left, right = np.zeros((n, WIDE + 1), np.uint8), np.zeros((n, WIDE + 1), np.uint8)
    left[row, column] = np.frombuffer(b"".join([w[:WIDE] for w in words]), np.uint8)
    right[row, column] = np.frombuffer(b"".join([w[: -WIDE - 1 : -1] for w in words]), np.uint8)
    letters = np.zeros(n, np.uint64)
    for c in range(WIDE):
        letters |= np.where(c < length, np.uint64(1) << (left[:, c] & np.uint8(63)).astype(np.uint64), np.uint64(0))
    change = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    after = np.repeat(change[1:], np.diff(change)) - np.arange(n) - 1  # rows of the list that follow
    a, found = np.flatnonzero(after >= 1), []
    step = 1
    while len(a):
        b = a + step
        near = np.abs(length[a] - length[b]) <= 1
        short = (length[a] <= WIDE) & (length[b] <= WIDE)
        both = letters[a] ^ letters[b]
        near &= ~short | ((np.bitwise_count(both & letters[a]) <= 1) & (np.bitwise_count(both & letters[b]) <= 1))
        x, y, short = a[near], b[near], short[near]
        u, v = x[short], y[short]
        if len(u):
            begin = (left[u] != left[v]).argmax(1)
            end = (right[u] != right[v]).argmax(1)
            same = (length[u] == length[v]) & (left[u] == left[v]).all(1)
            hit = ~same & (begin + end >= np.maximum(length[u], length[v]) - 1)
            found.append(np.stack([u[hit], v[hit]]))
        long = [(i, j) for i, j in zip(x[~short].tolist(), y[~short].tolist()) if one_edit(words[i], words[j])]
        if long:
            found.append(np.array(long).T)
        step += 1
        a = a[after[a] >= step]
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def merged(lists: DataFrame) -> DataFrame:
    """``word, other, other_n`` of near words, in both directions, from lists (token, word, n)."""

    def answer(token: np.ndarray, word: pa.Array, n: pa.Array) -> pa.RecordBatch:
        x, y = near_pairs(token, word.to_pylist())
        a, b = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
        return pa.RecordBatch.from_arrays([word.take(a), word.take(b), n.take(b)], ["word", "other", "other_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            if sum(b.num_rows for b in rest) < ROWS:
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            token = np.asarray(table["token"].combine_chunks())
            cut = int(np.searchsorted(token, token[-1]))  # whole lists only
            if cut:
                done = table.slice(0, cut)
                yield answer(token[:cut], done["word"].combine_chunks(), done["n"].combine_chunks())
                table = table.slice(cut).combine_chunks()
            rest = table.to_batches()
        if rest:
            table = pa.Table.from_batches(rest)
            yield answer(np.asarray(table["token"].combine_chunks()), table["word"].combine_chunks(), table["n"].combine_chunks())

    dealt = lists.repartition("token").sortWithinPartitions("token")
    return arrow_map(dealt, run, "word binary, other binary, other_n long").dropDuplicates(["word", "other"])


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for links (word, form): forms are followed to the last, twice as far in every round."""
    now = stage(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", places: int = PLACES) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = stage(word_counts(docs, id, text), "words")
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    threshold = max(places, total // NODES)
    near = stage(merged(postings(words, gram_dictionary(words, threshold))), "near-words")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.max("other_n").alias("most"))
    # bytes of Latin-1 sort as their code points do
    firsts = near.join(best, "word").filter("other_n = most").groupBy("word").agg(
        F.first("n_near").alias("n_near"), F.first("most").alias("most"), F.min("other").alias("other")
    )
    found = words.join(firsts, "word", "left")
    formed = F.col("most") >= RATIO * F.col("n")
    found = stage(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("other")).alias("form"),
            F.when(formed, F.col("most")).alias("form_n"),
        ),
        "forms-of-words",
    )
    named = found.join(roots(found.filter("form IS NOT NULL")), "word", "left")
    plain = lambda c: F.decode(c, "ISO-8859-1")
    return named.select(
        plain("word").alias("word"), plain("form").alias("form"), plain(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n"
    )


#: Near words by the two exact forms of one edit: a symbol left out, or equal but for one place.
SQL = r"""
WITH tab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
runs AS MATERIALIZED (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) WHERE length(r) >= 7 GROUP BY ALL),
h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295,
    list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS h FROM runs, tab),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM h)
    WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, word[1:i - 1] AS a, word[i + 1:] AS b, a || b AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (SELECT x.word AS a, y.word AS b FROM less x JOIN v y ON y.word = x.s
    UNION SELECT y.word, x.word FROM less x JOIN v y ON y.word = x.s
    UNION SELECT x.word, y.word FROM less x JOIN less y ON x.a = y.a AND x.b = y.b AND x.word <> y.word),
top AS (SELECT a, n_near, n AS most, b FROM (SELECT near.a, b, v.n, count(*) OVER (PARTITION BY near.a) AS n_near,
    row_number() OVER (PARTITION BY near.a ORDER BY v.n DESC, encode(b)) AS k FROM near JOIN v ON v.word = b) WHERE k = 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 10 * v.n THEN b END AS form,
    CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN top ON top.a = v.word)
SELECT f.word, f.form, coalesce(e.form, d.form, c.form, b.form, f.form, f.word) AS root, f.n, f.n_near, f.form_n FROM f
LEFT JOIN f b ON b.word = f.form LEFT JOIN f c ON c.word = b.form LEFT JOIN f d ON d.word = c.form LEFT JOIN f e ON e.word = d.form
"""
