"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic means.

1. A lexicon has two parts: fixed words by group (:data:`GROUPS`), and stems (beginnings of words) that labelled texts
   show to be toxic: held by ``LEAST_SHARE`` of the toxic ones at least, and ``LEAST_LIFT`` times as often as in others.
   These are counted on ``LEXICON_ROWS`` labelled rows at most (those with the least hashes of their ids); what is
   broadcast has that bound.
2. One scan turns every whole text into :data:`FEATURES`: densities of the lexicon, how near its words stand to a second
   person, capitals, punctuation, and how many words hide behind digits, symbols, stretched or spaced letters. Hidden
   words are read plain and count for the lexicon.
3. Spark fits boosted trees on all labelled rows, no sample. Of the rows to learn from, one remainder is kept: the trees'
   chances of its rows are counted in ``BINS`` bins, and pooled means that never fall make the score.

Rows learn by crc32 of the id as text: remainder 0 of 5 is held out, 1 calibrates, the others fit. Labels, language,
source and id are no inputs. Defined cases: null texts are empty ones and score as such; null ids are never learned from
and count as not held out; repeated rows each get a row back; without labels the score is 0.5; with labels of one kind
only it tends to that label; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, no_text, stage
from fleetlens.llm.quality_classifier import pooled

#: Abuse in the four languages of the texts, by group.
GROUPS = {
    "persons": (
        "idiot idiots moron morons imbecile fool fools clown clowns loser losers scum vermin jerk bastard coward liar freak "
        "dummkopf trottel abschaum versager vollidiot arschloch schwein feigling idioten "
        "idiote crétin imbécile connard salaud ordure minable lâche "
        "idiota idiotas imbécil payaso escoria cretino cobarde basura perdedor"
    ).split(),
    "contempt": (
        "stupid dumb pathetic worthless disgusting useless ugly filthy trash garbage ridiculous hopeless "
        "dumm blöd erbärmlich wertlos widerlich ekelhaft nutzlos hässlich müll "
        "stupide pathétique dégoûtant inutile répugnant débile "
        "estúpido estúpida patético asqueroso inútil ridículo"
    ).split(),
    "threats": (
        "kill shoot hurt hate töten verrecke hasse crève matar muere odio".split()
    ),
    "profanity": "damn hell crap shit fuck fucking bitch scheiße verdammt fick merde putain mierda joder puta".split(),
}
#: Words that address somebody.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted ustedes vosotros tus".split()
)
#: What digits and symbols stand for when they hide a letter.
HIDDEN = str.maketrans("013457@$!|€+", "oieastasiiet")

NEAR, SAMPLED = 5, "learned"
FEATURES = [
    "log_words", *(f"{kind}_{g}" for g in [*GROUPS, SAMPLED] for kind in ("density", "log")), "lexicon_kinds", "second_person",
    "nearest_address", "addressed", "upper", "shouted_words", "shouted_lexicon", "marks", "mark_runs", "hidden_words", "hidden_lexicon",
    "stretched", "spaced", "symbols",
]

TREES, DEPTH, STEP, LEAST_ROWS, BINS, SEED = 40, 3, 0.2, 4, 200, 13
FOLDS, HELD_OUT, CALIBRATES, TOXIC = 5, 0, 1, 0.5
LEXICON_ROWS, STEMS, LEAST_TOXIC, LEAST_SHARE, LEAST_LIFT, STEM = 20_000, 200, 3, 0.02, 10, range(4, 9)

_LEXICON = {w: g for g, words in GROUPS.items() for w in words}
_WORD = re.compile(r"[^\W\d_]+")
#: A word with digits or symbols between or before its letters; its plain form is looked up.
_MIXED = re.compile(r"(?<![^\s(\"'])[^\W_]*[A-Za-z][0-9@$!|€+*._-]+[A-Za-z][\w@$!|€+*.-]*|(?<!\S)[0-9@$!|€+]+[A-Za-z][\w@$!|€+*.-]*")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\S)")
_MARKS = re.compile(r"[!?]{2,}")
_CAPITALS = bytes(range(0x41, 0x5B))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


class Lexicon:
    """The fixed words by group, and learned stems."""

    def __init__(self, stems: list[str] = ()) -> None:
        self.stems = frozenset(stems)
        self.sizes = sorted({len(s) for s in stems})

    def group(self, word: str) -> str | None:
        """The group of a word in lower case."""
        if (group := _LEXICON.get(word)) is not None:
            return group
        return SAMPLED if any(word[:q] in self.stems for q in self.sizes) else None

    def groups(self, words: Iterable[str]) -> dict[str, str]:
        """The words that are in the lexicon, with their groups."""
        found = {}
        for q in self.sizes:
            found.update((w, SAMPLED) for w in words if w[:q] in self.stems)
        found.update((w, _LEXICON[w]) for w in words if w in _LEXICON)
        return found


def plain_forms(text: str, known: Lexicon) -> tuple[int, int, int, Counter]:
    """Words hidden behind symbols, stretched letters and spaced letters: how many, and the lexicon's groups they are of."""
    groups: Counter = Counter()
    mixed = _MIXED.findall(text)
    for word in mixed:
        word = word.lower()
        for form in (word.translate(HIDDEN), re.sub(r"[^\w]|_", "", word)):
            if (group := known.group(re.sub(r"[^\w]|[\d_]", "", form))) is not None:
                groups[group] += 1
                break
    stretched = 0
    if _STRETCHED.search(text):
        for word in words_of(text):
            if _STRETCHED.search(word):
                stretched += 1
                group = known.group(_STRETCHED.sub(r"\1", word).lower()) or known.group(_STRETCHED.sub(r"\1\1", word).lower())
                if group is not None and known.group(word.lower()) is None:
                    groups[group] += 1
    spaced = _SPACED.findall(text)
    for run in spaced:
        if (group := known.group(re.sub(r"[^\w]|_", "", run).lower())) is not None:
            groups[group] += 1
    return len(mixed), stretched, len(spaced), groups


def features(text: str, known: Lexicon) -> list[float]:
    """:data:`FEATURES` of one whole text."""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    groups: Counter = Counter()
    abusive = known.groups(counts)
    for w, group in abusive.items():
        groups[group] += counts[w]
    mixed, stretched, spaced, hidden = plain_forms(text, known)
    groups.update(hidden)
    address = sum(counts[w] for w in counts.keys() & SECOND_PERSON)
    nearest, addressed, shouted_hits = 0.0, 0, 0
    if abusive:
        hits = np.array([i for i, w in enumerate(lower) if w in abusive])
        shouted_hits = sum(words[i].isupper() for i in hits)
        if address:
            people = np.array([i for i, w in enumerate(lower) if w in SECOND_PERSON])
            after = np.searchsorted(people, hits)
            gap = np.minimum(
                np.abs(people[np.minimum(after, len(people) - 1)] - hits), np.abs(people[np.maximum(after - 1, 0)] - hits)
            )
            nearest, addressed = 1 / (1 + float(gap.min())), int((gap <= NEAR).sum())
    shouted = sum(len(w) > 1 and w.isupper() for w in words)
    letters = sum(map(len, words))
    raw = text.encode(errors="replace")
    upper = len(raw) - len(raw.translate(None, _CAPITALS))
    densities = [x for g in [*GROUPS, SAMPLED] for x in (100 * groups[g] / n, float(np.log1p(groups[g])))]
    return [
        float(np.log1p(n)), *densities, float(sum(v > 0 for v in groups.values())), 100 * address / n, nearest,
        100 * addressed / n, upper / max(letters, 1), shouted / n, float(shouted_hits), 100 * (text.count("!") + text.count("?")) / n,
        100 * len(_MARKS.findall(text)) / n, 100 * mixed / n, float(sum(hidden.values())), 100 * stretched / n, float(spaced),
        100 * sum(map(text.count, "#*$%&@")) / n,
    ]


def fold(id: str) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % FOLDS


def learned_stems(docs: DataFrame, known: DataFrame, rows: int = LEXICON_ROWS) -> list[str]:
    """Beginnings of words that labelled texts show to be toxic: :data:`STEMS` at most.

    ``docs`` has id and text, ``known`` id and y. Copies of a text count once.
    """
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.join(F.broadcast(chosen), "id").groupBy(F.md5(F.col("text").cast("binary"))).agg(
        F.first("text").alias("text"), F.max("y").alias("y")
    )
    schema = "stem string, clean long, toxic long, documents long"

    def out(total: dict[str, list[int]]) -> pa.RecordBatch:
        counts = np.array(list(total.values()), np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *map(pa.array, counts.T)], ["stem", "clean", "toxic", "documents"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                y = y.as_py()
                stems: Counter = Counter({"": 1})
                for w, n in Counter(w.lower() for w in words_of(text.as_py())).items():
                    for q in STEM:
                        if len(w) >= q:
                            stems[w[:q]] += n
                for stem, n in stems.items():
                    row = total.setdefault(stem, [0, 0, 0])
                    row[y] += n
                    row[2] += y
                if len(total) > 1 << 18:
                    yield out(total)
                    total = {}
        yield out(total)

    counted = arrow_map(texts.select("text", F.col("y").cast("int")), run, schema).groupBy("stem")
    counted = stage(counted.agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "documents"))), "stems-by-label")
    total = counted.filter("stem = ''").first()
    if total is None or not total.toxic or not total.clean:
        return []
    # three more in clean texts than seen, so that chance alone lifts nothing
    lift = (F.col("toxic") / total.toxic) / ((F.col("clean") + 3) / (total.clean + 1))
    enough = (F.col("documents") >= LEAST_TOXIC) & (F.col("documents") >= LEAST_SHARE * total.toxic) & (lift >= LEAST_LIFT)
    best = counted.filter((F.col("stem") != "") & enough).orderBy(F.desc(F.col("documents") * F.log(lift)), F.length("stem"), "stem")
    chosen_stems: list[str] = []
    for r in best.limit(len(STEM) * STEMS).collect():
        if not any(r.stem.startswith(s) or s.startswith(r.stem) for s in chosen_stems):
            chosen_stems.append(r.stem)
    return chosen_stems[:STEMS]


def with_features(docs: DataFrame, stems: list[str]) -> DataFrame:
    """``id``, ``x`` for ``docs`` with id and text."""
    known = Lexicon(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = [features(t.as_py(), known) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return arrow_map(docs.select("id", "text"), run, f"id {docs.schema['id'].dataType.simpleString()}, x array<double>")


def fit(rows: DataFrame) -> GBTClassificationModel:
    """Boosted trees on rows (x, y)."""
    trees = GBTClassifier(
        featuresCol="v", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=LEAST_ROWS, maxBins=64, seed=SEED
    )
    return trees.fit(rows.select(array_to_vector("x").alias("v"), F.col("y").cast("double")))


def chances(rows: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """The rows with ``p``, the trees' chance of label 1."""
    model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p")
    return model.transform(rows.withColumn("v", array_to_vector("x"))).withColumn("p", vector_to_array("_p")[1]).drop("v", "_p")


def levels(rows: DataFrame) -> np.ndarray:
    """Isotonic means of the labels over ``BINS`` bins of p, from at most so many counted rows."""
    binned = rows.groupBy(F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin"))
    counts, ones = np.zeros(BINS), np.zeros(BINS)
    for r in binned.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect():
        counts[r.bin], ones[r.bin] = r.n, r.ones
    return pooled(counts, ones)


def calibrated(p: Column, means: np.ndarray) -> Column:
    """The mean of the bin, with lines between the middles of bins."""
    table = F.array(*[F.lit(float(v)) for v in means])
    at = F.least(F.greatest(p * BINS - 0.5, F.lit(0.0)), F.lit(BINS - 1.0))
    low = F.least(F.floor(at), F.lit(BINS - 2)).cast("int")
    return F.get(table, low) + (at - low) * (F.get(table, low + 1) - F.get(table, low))


def scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    rows = docs.select(F.col(id).alias("id"), no_text(text).alias("text"))
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(fold("id") != HELD_OUT)
    found = stage(with_features(rows, learned_stems(rows, known)), "toxicity-features")
    learned = stage(found.join(known, "id").select("x", "y", fold("id").alias("fold")), "toxicity-labelled")
    kinds = {(r.calibrates, r.y): r.n for r in learned.groupBy((F.col("fold") == CALIBRATES).alias("calibrates"), "y").agg(F.count("*").alias("n")).collect()}
    of = lambda y, parts=(False, True): sum(kinds.get((part, y), 0) for part in parts)
    if not of(0) or not of(1):
        scored = found.withColumn("score", F.lit((of(1) + 0.5) / (of(0) + of(1) + 1)))
    else:
        # too few rows to keep some apart: both steps take all
        whole = not all(kinds.get((part, y)) for part in (False, True) for y in (0, 1))
        model = fit(learned if whole else learned.filter(F.col("fold") != CALIBRATES))
        means = levels(chances(learned if whole else learned.filter(F.col("fold") == CALIBRATES), model))
        scored = chances(found, model).withColumn("score", calibrated(F.col("p"), means))
    held = F.coalesce(fold("id") == HELD_OUT, F.lit(False))
    return scored.select(F.col("id").alias(id), held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
