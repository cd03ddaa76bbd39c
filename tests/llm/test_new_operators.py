"""Ranked search, spelling variants, toxicity: beside brute force and over odd rows; sound hashes; redaction."""

import random
import re
from collections import Counter
from math import floor, log
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest

from pyspark.sql import functions as F

from fleetlens.llm import lexical_search, minhash_dedup, queries, secret_scan, sharding, spelling_variants, substring_dedup, suffix_dedup, toxicity
from fleetlens.llm.common import hash60, no_text, stage

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, length = sum(bool(t) for _, t in bags), sum(len(t) for _, t in bags)
    df = Counter(w for _, t in bags for w in set(t))
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, t in bags:
            tf, m = Counter(t), 25 + 75 * len(t) * n_docs // max(length, 1)
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in terms(text) if tf[w])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def search_corpus():
    r = random.Random(5)
    word = lambda: r.choice(["Alpha", "beta", "g\u00e4mma", "d3lta", "eps", "\u017fz", "the", "of", "a"])
    text = lambda n: " ".join(word() + r.choice(["", ",", "-x", "\x7f", "_"]) for _ in range(n))
    docs = [(i, text(r.randrange(1, 40))) for i in range(120)] + [(200 + i, "the alpha of beta") for i in range(30)]
    docs += [(900, None), (901, ""), (902, " .,- "), (None, "alpha alpha beta"), (7, "repeated id alpha"), (200, "the alpha of beta"), (903, text(60_000))]
    items = [(i, text(r.randrange(1, 12))) for i in range(9)] + [(50, None), (51, "nowhere"), (52, "ALPHA alpha"), (0, "beta"), (52, "ALPHA alpha"), (None, "eps")]
    return docs, items


@pytest.mark.parametrize("block", [256, 4])
def test_search_beside_brute_force(spark, block):
    docs, items = search_corpus()
    rows = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, m long, bag string")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score long")
    found = lexical_search.ranked_search(rows, asked, block=block).collect()
    assert sorted(map(tuple, found), key=repr) == plain_search(docs, items, 10)
    assert lexical_search.ranked_search(rows.limit(0), asked).collect() == []
    assert lexical_search.ranked_search(rows, asked.limit(0)).collect() == []


def test_large_scores_are_exact():
    index = lexical_search.ItemIndex([b"a " * 400_000 + b"b"])
    index.weigh(10**9, {0: 1, 1: 3})
    bag = np.array([[0, 999_999_937], [1, 7]], np.int32).tobytes()
    m = 25
    want = sum(int(index.weight[t]) * (10**9 * tf // (1000 * tf + 8 * m)) * n for t, tf, n in ((0, 999_999_937, 400_000), (1, 7, 1)))
    assert index.scores([bag], np.array([m])).tolist() == [[want]]


def plain_variants(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if spelling_variants.one_edit(w.encode("latin-1"), v.encode("latin-1"))] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variant_corpus():
    r = random.Random(11)
    syllables = ["tion", "ing", "er", "\u00e9t", "ab", "lo", "\u00df", "qu", "ness", "pre"]
    words = ["".join(r.choice(syllables) for _ in range(r.randrange(2, 7))) for _ in range(700)]
    words += ["aaaaaaaa" + "a" * i for i in range(14)] + ["x" * 40, "x" * 41, "x" * 20 + "y" + "x" * 19] + ["\u00d7\u00f7" * 5, "\u00d7\u00f7" * 5 + "\u00d7"]
    out = []
    for i in range(150):
        picked = []
        for w in r.choices(words, weights=[1 + 40 * (j % 9 == 0) for j in range(len(words))], k=60):
            if r.random() < 0.1:
                p = r.randrange(len(w))
                w = r.choice([w[:p] + w[p + 1 :], w[:p] + "z" + w[p:], w[:p] + "z" + w[p + 1 :]])
            picked.append(w.upper() if w.isascii() and r.random() < 0.2 else w)
        out.append((i, " ".join(picked) + r.choice(["", "1", "\u0101", "\n"])))
    return out + [(500, None), (501, ""), (None, " ".join(words[:300])), (3, out[3][1]), (502, ("q" * 3000 + " ") * 3), (503, "q" * 3001 + " " + "q" * 3001)]


@pytest.mark.parametrize("places", [256, 20, 2])
def test_variants_beside_brute_force(spark, places):
    docs = variant_corpus()
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, n long")
    found = spelling_variants.spelling_variants(rows, places=places).collect()
    got = sorted(map(tuple, found), key=repr)
    want = plain_variants(docs)
    assert got == want and any(r[1] for r in want)
    assert spelling_variants.spelling_variants(rows.limit(0)).collect() == []


def test_one_edit():
    near = spelling_variants.one_edit
    assert near(b"abc", b"abd") and near(b"abc", b"abcd") and near(b"abcd", b"acd") and near(b"", b"a")
    assert not near(b"abc", b"abc") and not near(b"abc", b"acb") and not near(b"abc", b"abcde") and not near(b"ab", b"cd")


def tox_corpus():
    r = random.Random(2)
    calm = lambda n: " ".join(r.choice(["river", "stone", "cloud", "walks", "quiet", "under", "green", "you"]) for _ in range(n))
    rude = ["idiot", "1d10t", "s.t.u.p.i.d", "loooser", "m o r o n", "WORTHLESS", "zorgbla", "zorgblitz"]
    rows = [(i, calm(30), 0) for i in range(160)]
    return rows + [(1000 + i, f"{calm(10)} you {r.choice(rude)} {r.choice(rude)} {calm(12)}", 1) for i in range(90)]


def test_toxicity_of_held_out_and_odd_rows(spark):
    rows = tox_corpus()
    docs = spark.createDataFrame([(d, t, 1.0) for d, t, _ in rows] + [(None, None, 1.0), (5000, "", 1.0), (5000, "", 1.0), (5001, "word " * 60_000, 1.0)], "doc_id long, text string, p double")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (77_777, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.scores(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    truth = {d: y for d, _, y in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert len({r.score for r in found if r.doc_id == 5000}) == 1
    assert toxicity.scores(docs.limit(0), labels).collect() == []
    assert {r.score for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.5}
    ones = {r.score for r in toxicity.scores(docs, labels.filter("toxic = 1")).collect()}
    assert len(ones) == 1 and ones.pop() > 0.9


def test_hidden_words_are_read_plain():
    known = toxicity.Lexicon(["zorgbl"])
    for text in ("1d10t", "st*pid s.t.u.p.i.d", "looooser", "m o r o n", "zorgblaaaat"):
        assert sum(toxicity.plain_forms(text, known)[3].values()) + len(known.groups([text])) > 0, text
    assert not toxicity.plain_forms("well-known e.g. 3rd a b c", known)[3] and not known.groups(["zorg", "river"])


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables here")
def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.QUERIES["op13_toxicity"](spark, folder).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95


def folded(a, b):
    """A word of 1,024 letters whose image under any odd polynomial modulo 2^64 is that of its complement."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(1024))


def test_words_that_collide_modulo_powers_of_two(spark):
    one, two = " ".join([folded("a", "b")] * 60), " ".join([folded("b", "a")] * 60)
    long, other = " ".join(folded("a", "b")), " ".join(folded("b", "a"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, long + " end"), (4, "start " + other)], "doc_id long, text string")
    found = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert found[1].kept and found[2].kept
    gone = {r.doc_id: r.n_removed for r in substring_dedup.repeats_report(docs).collect()}
    # the letters of the two sequences share stretches of their own, which is right
    assert gone[1] == gone[2] == gone[3] == 0
    short = spark.createDataFrame([(1, folded("a", "b")), (2, folded("b", "a"))], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.repeats_report(short, length=1000).collect()] == [0, 0]


def test_redaction_keeps_the_columns_of_the_caller(spark):
    rows = [(1, 'token = "abcdefghijkl0123"', "mine", "new", True, {"row": 5}), (2, None, None, "x", None, None), (3, "plain", "y", None, False, {"row": 6})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, new string, _was boolean, row struct<row: int>")
    out = secret_scan.redact(docs)
    assert out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert all((got[d]._text, got[d].new, got[d]._was) == (a, b, c) for d, _, a, b, c, _ in rows)
    assert got[1].row.row == 5 and got[2].text is None and got[3].text == "plain" and "abcdefghijkl0123" not in got[1].text


@pytest.mark.parametrize("kind", ["empty texts", "one text", "one row", "one id"])
def test_hot_keys_are_divided_into_cells(spark, kind):
    hot = {"empty texts": lambda i: (i, ""), "one text": lambda i: (i, "the same"), "one row": lambda i: (7, "the same"), "one id": lambda i: (None, f"text {i}")}
    rows = [hot[kind](i) if i % 3 == 0 else (i, f"text {i} " + "x" * (i % 90)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = docs.select(
        hash60(no_text("text")).alias("key"), hash60(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":shard"))).alias("tie"),
        (F.rand(0) * float(sharding.KEYS)).cast("long").alias("dice"),
    )
    keyed = stage(keyed, "keyed")
    cells = sharding.with_cells(keyed, [sharding.KEYS // 4, sharding.KEYS // 2], 100)
    by_cell = cells.groupBy(*sharding.CELL).agg(F.count("*").alias("n"), F.min(F.struct("key", "tie")).alias("a"), F.max(F.struct("key", "tie")).alias("b"))
    found = sorted(by_cell.collect(), key=lambda r: [r[c] for c in sharding.CELL])
    assert sum(r.n for r in found) == 6000 and max(r.n for r in found) <= 200
    assert all(x.b <= y.a for x, y in zip(found, found[1:]))  # cells follow the order of the keys
    shards = sharding.shard_by_splitters(docs, cell_rows=100).collect()
    total, seen = sum(r.size for r in shards), {}
    for r in shards:
        seen.setdefault(r.shard, []).append(r)
    for part in seen.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 16) <= 2 * max(r.size for r in shards)
