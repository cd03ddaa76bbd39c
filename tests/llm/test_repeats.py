"""Substring and suffix-array dedup beside brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def key(doc):
    return (doc is None, doc or 0)


def by_words(rows, length):
    first, out = {}, []
    rows = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in rows:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, key(d)), key(d))
    for d, w in rows:
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < key(d):
                gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), digest(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def by_bytes(rows, length):
    first, out = {}, []
    rows = [(d, (t or "").encode()) for d, t in rows]
    for d, b in rows:
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, (key(d), i)), (key(d), i))
    for d, b in rows:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (key(d), i):
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), len(b) - len(kept), spans, digest(kept)))
    return out


def corpus():
    r = random.Random(7)
    words = ["é", "wort", "a", "b\x00c", "ñandú", "of", "the", "x" * 30, "\xa0", "12"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", "\n", "\t "]) for _ in range(n))
    passage, body = text(90), text(300)
    rows = [(1, text(200) + passage), (2, passage + text(40)), (3, body), (4, body), (5, "a " * 400), (6, "b " * 30 + "a " * 200)]
    rows += [(7, None), (8, ""), (9, "short"), (None, body), (10, text(20) + passage + text(20) + passage), (11, body), (11, body)]
    near = body.split(" ")
    for i in range(12, 40):
        copy = list(near)
        copy[r.randrange(len(copy))] = "edit"
        rows.append((i, " ".join(copy)))
    return rows


CASES = [(substring_dedup, by_words, 50), (suffix_dedup, by_bytes, 100)]


@pytest.mark.parametrize("most", [1 << 17, 1])
@pytest.mark.parametrize("module,brute,length", CASES)
def test_beside_brute_force(spark, module, brute, length, most):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, digest string")
    found = module.repeats_report(docs, most=most).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows, length)))


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_empty_table(spark, module):
    assert module.repeats_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=5))
def test_two_stage_sorting(contents):
    text = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8) + np.uint8(1)
    depth = 12
    sa = suffix_array(text, depth)
    body = text.tobytes() + b"\0" * depth
    keys = [body[i : i + depth] for i in sa]
    assert sorted(sa.tolist()) == list(range(len(text)))
    # the order matters for strings that do not cross the end of a content
    whole = [k for k in keys if b"\0" not in k]
    assert whole == sorted(whole)


suffix_array = suffix_dedup.suffix_array
