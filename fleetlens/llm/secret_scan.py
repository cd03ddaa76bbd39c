"""Secret scans: base patterns, and a character convolutional network over every candidate and its context.

Candidates are all runs of 16 or more characters of ``[A-Za-z0-9+/_=-]`` of whole texts. The network reads a candidate
and ``CONTEXT`` characters on either side: embedded characters, one convolution, maxima and means over the candidate and
maxima over the context, one dense layer. A longer candidate is read in overlapping pieces of ``PIECE`` characters, all
of them, and its highest score counts. Every candidate is scored; where one reaches the threshold, the parts of it that no
base span covers are added as kind ``net``.

Labelled findings: ``SAMPLE`` candidates of the corpus at most of each label (those with the least hashes; label 1 where
a base span meets them), and as many made ones: secrets of usual formats, and harmless codes, names and numbers, set
into the contexts of the sample. A quarter calibrates: a logistic fit of the scores, then the highest threshold that
still finds ``RECALL`` of the labelled secrets. Training is seeded, so reruns agree.

Defined cases: null and empty texts have no spans; repeated rows each get a row back; an empty corpus trains on made
findings alone; other columns are not read, but :func:`redact` keeps them.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetlens.llm.common import arrow_map, no_text, stage

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

KINDS = ("assign", "access", "hex", "net")
CONTEXT, PIECE, STEP = 24, 64, 48
SAMPLE, MADE, RECALL, SEED = 1500, 4000, 0.95, 5
EMBED, FILTERS, WIDTH, EPOCHS = 12, 32, 5, 10
LENGTH = PIECE + 2 * CONTEXT

Span = tuple[int, int, int]  # start, position of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """The base spans by start and kind, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, bool, list[tuple[int, int]]]]:
    """Start and end of every candidate, whether a base span meets it, and its parts that none covers."""
    reach, at = 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        rest, parts = max(start, reach), []
        while at < len(base) and base[at][0] < end:
            if base[at][0] > rest:
                parts.append((rest, base[at][0]))
            reach = max(reach, base[at][2])
            rest = max(rest, reach)
            at += 1
        if rest < end:
            parts.append((rest, end))
        yield start, end, reach > start, parts


def pieces(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """The candidate in pieces, each with its context: text, and where the piece starts and ends in it."""
    out = []
    for a in range(start, max(end - (PIECE - STEP), start + 1), STEP):
        b = min(a + PIECE, end)
        first = max(a - CONTEXT, 0)
        out.append((text[first : b + CONTEXT], a - first, b - first))
    return out


def coded(rows: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers (0 none, 1 other, then ASCII), and 1 for the piece, 0 for context, -1 for none."""
    x, part = np.zeros((len(rows), LENGTH), np.int64), np.full((len(rows), LENGTH), -1, np.int8)
    for i, (text, a, b) in enumerate(rows):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        x[i, : len(codes)] = np.where(codes < 128, codes + 2, 1)
        part[i, : len(codes)] = 0
        part[i, a:b] = 1
    return x, part


class Network:
    """Embedding, convolution, pools, dense layer; trained by Adam."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.3, (130, EMBED)),
            "conv": r.normal(0, 0.15, (WIDTH * (EMBED + 1), FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.1, 3 * FILTERS),
            "level": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray, part: np.ndarray) -> tuple:
        inside = (part == 1).astype(float)
        units = np.concatenate([self.w["embed"][x], inside[:, :, None]], 2) * (part >= 0)[:, :, None]
        half = WIDTH // 2
        wide = np.pad(units, ((0, 0), (half, half), (0, 0)))
        cols = np.concatenate([wide[:, i : i + LENGTH] for i in range(WIDTH)], 2)
        h = np.maximum(cols @ self.w["conv"] + self.w["bias"], 0)
        n = np.maximum(inside.sum(1), 1)[:, None]
        own, other = h * inside[:, :, None], h * (part == 0)[:, :, None]
        pools = np.concatenate([own.max(1), own.sum(1) / n, other.max(1)], 1)
        return pools @ self.w["out"] + self.w["level"][0], pools, own, other, h, cols, inside, n

    def logits(self, rows: list[tuple[str, int, int]]) -> np.ndarray:
        parts = [self._forward(*coded(rows[i : i + 256]))[0] for i in range(0, len(rows), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _gradients(self, x: np.ndarray, part: np.ndarray, y: np.ndarray) -> dict:
        z, pools, own, other, h, cols, inside, n = self._forward(x, part)
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        dp = d[:, None] * self.w["out"]
        dh = np.zeros_like(h)
        rows, filters = np.arange(len(y))[:, None], np.arange(FILTERS)[None]
        np.add.at(dh, (rows, own.argmax(1), filters), dp[:, :FILTERS])
        np.add.at(dh, (rows, other.argmax(1), filters), dp[:, 2 * FILTERS :])
        dh += (dp[:, FILTERS : 2 * FILTERS] / n)[:, None, :] * inside[:, :, None]
        dh *= h > 0
        dcols = dh @ self.w["conv"].T
        half, size = WIDTH // 2, EMBED + 1
        dwide = np.zeros((len(y), LENGTH + 2 * half, size))
        for i in range(WIDTH):
            dwide[:, i : i + LENGTH] += dcols[:, :, i * size : (i + 1) * size]
        dunits = (dwide[:, half : half + LENGTH] * (part >= 0)[:, :, None])[:, :, :EMBED]
        dembed = np.zeros_like(self.w["embed"])
        np.add.at(dembed, x, dunits)
        return {
            "embed": dembed, "conv": np.tensordot(cols, dh, ([0, 1], [0, 1])), "bias": dh.sum((0, 1)),
            "out": pools.T @ d, "level": d.sum(keepdims=True),
        }

    def fit(self, rows: list[tuple[str, int, int]], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
        """Three quarters of the rows train, the others calibrate."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(rows))
        held, used = order[: len(rows) // 4], order[len(rows) // 4 :]
        mean, square, t = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for _ in range(epochs):
            for batch in np.array_split(r.permutation(used), max(len(used) // 64, 1)):
                t += 1
                for k, g in self._gradients(*coded([rows[i] for i in batch]), y[batch]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.w[k] -= 0.004 * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
        return self.calibrate(self.logits([rows[i] for i in held]), y[held])

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float = RECALL) -> Network:
        """Logistic fit of the labels on the scores (smoothed, so it stays finite), then the threshold."""
        a, b, n1 = 1.0, 0.0, y.sum()
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-6)
            hessian = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
            da, db = np.linalg.solve(hessian, [((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
            a, b = max(a - np.clip(da, -0.5, 0.5), 0.05), b - np.clip(db, -1, 1)
        self.scale, self.shift = float(a), float(b)
        found = np.sort(self.chance(z[y == 1]))[::-1]
        self.threshold = float(found[max(int(np.ceil(recall * len(found))) - 1, 0)]) if len(found) else 1.0
        return self

    def chance(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def made_findings(n: int, contexts: list[tuple[str, str]], seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """Labelled findings, half secrets and half harmless, in the given contexts: text, start, end, label."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    mixed = letters + letters.upper() + "0123456789"
    some = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    word = lambda: some("aeiouaeiou" + letters, 2, 10)
    secrets = [
        lambda: some(mixed, 20, 60), lambda: some(mixed + "+/", 24, 80) + "=", lambda: "ghp_" + some(mixed, 36, 36),
        lambda: "sk-" + some(mixed, 32, 48), lambda: some("0123456789abcdef", 32, 64), lambda: some(mixed + "-_", 20, 44),
        lambda: "AIza" + some(mixed + "-_", 35, 35), lambda: "eyJ" + some(mixed, 30, 80), lambda: some(letters.upper() + "0123456789", 20, 32),
    ]
    harmless = [
        lambda: "".join(word() for _ in range(r.randint(4, 9))), lambda: some("0123456789", 16, 20), lambda: "_".join(word() for _ in range(5)),
        lambda: "".join(word().title() for _ in range(5)), lambda: "/".join(word() for _ in range(5)), lambda: r.choice("=-_/+") * r.randint(16, 60),
        lambda: "".join(word() for _ in range(5)).upper(), lambda: "-".join(word() for _ in range(4)) + "-" + some("0123456789", 2, 6),
        lambda: some("0123456789", 4, 4) + "-" + some("0123456789", 4, 4) + "-" + some("0123456789", 8, 8),
    ]
    out = []
    for i in range(n):
        before, after = r.choice(contexts) if contexts else (f"{word()} {word()} ", f" {word()}")
        body, label = (r.choice(secrets)(), 1) if i % 2 else (r.choice(harmless)(), 0)
        while len(body) < 16:
            body += r.choice(letters)
        if label and r.random() < 0.5:
            before = before[-12:] + r.choice(["key: ", "token ", "auth=", 'credential "', "Bearer "])
        text, at = f"{before[-CONTEXT:]}{body}{after}", len(before[-CONTEXT:])
        out.append((*pieces(text, at, at + len(body))[0], label))
    return out


SAMPLE_SCHEMA = pa.schema([("piece", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("label", pa.int32()), ("at", pa.int64())])


def labelled_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every candidate's first piece with its context and label, and a hash of it: piece, a, b, label, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                body = body.as_py()
                base = base_spans(body)
                rows = [(*pieces(body, a, b)[0], int(met)) for a, b, met, _ in candidates(body, base)]
                if rows:
                    at = [int.from_bytes(hashlib.md5(repr(x).encode()).digest()[:7]) for x in rows]
                    yield pa.RecordBatch.from_pylist([dict(zip("piece a b label at".split(), (*x, h))) for x, h in zip(rows, at)], SAMPLE_SCHEMA)

    return arrow_map(docs.select(no_text(text).alias("text")), run, "piece string, a int, b int, label int, at long")


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, made: int = MADE) -> Network:
    """A network trained on ``sample`` candidates of the corpus of each label at most, and ``made`` findings."""
    found = stage(labelled_candidates(docs, text), "labelled-candidates").distinct()
    rows = []
    for label in (0, 1):
        rows += found.filter(F.col("label") == label).orderBy("at", "piece", "a").limit(sample).collect()
    contexts = [(x.piece[: x.a], x.piece[x.b :]) for x in rows if x.label == 0]
    labelled = [(x.piece, x.a, x.b, x.label) for x in rows] + made_findings(made, contexts)
    y = np.array([x[3] for x in labelled], float)
    return Network().fit([x[:3] for x in labelled], y)


def all_spans(texts: list[str], network: Network) -> list[list[Span]]:
    """Base and added spans of every text; the candidates of all texts are scored together."""
    out, rows, owners = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append(base)
        for a, b, _, parts in candidates(text, base):
            cut = pieces(text, a, b)
            rows += cut
            owners += [(i, a, parts)] * len(cut)
    chances = network.chance(network.logits(rows))
    added = {o[:2]: o[2] for o, p in zip(owners, chances) if p >= network.threshold}
    for (i, _), parts in added.items():
        out[i] = [*out[i], *((a, 3, b) for a, b in parts)]
    return [sorted(x) for x in out]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with the mark in place of every span; spans that overlap get one mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mapped(rows: DataFrame, network: Network, columns: dict[str, tuple], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` (and its ``_text``) with columns made of (text, spans)."""
    names, at = [*keep, *columns], rows.columns.index("_text")
    kept = [rows.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(at).to_pylist()
                found = list(zip(texts, all_spans(texts, network)))
                made = [pa.array([f(*x) for x in found], t) for _, t, f in columns.values()]
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in kept), *made], names)

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return arrow_map(rows, run, ", ".join(fields + [f"{n} {kind}" for n, (kind, _, _) in columns.items()]))


def secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", network: Network | None = None) -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256, spans."""
    network = network or train(docs, text)
    rows = docs.select(F.col(id).alias("_id"), no_text(text).alias("_text"))
    number = lambda k: ("long", pa.int64(), lambda _, s: sum(x[1] == k for x in s))
    digest = lambda _, s: hashlib.sha256(listed([x for x in s if x[1] < 3]).encode()).hexdigest()
    columns = {
        "n_assign": number(0), "n_access": number(1), "n_hex": number(2),
        "base_sha256": ("string", pa.string(), digest), "spans": ("string", pa.string(), lambda _, s: listed(s)),
    }
    return _mapped(rows, network, columns, ["_id"]).withColumnRenamed("_id", id)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", network: Network | None = None) -> DataFrame:
    """``docs`` with every secret replaced; a null text stays null. ``n_chars`` counts anew where a text changed.

    A row travels as one struct, so that no column of the caller's can clash with those made here.
    """
    network = network or train(docs, text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column(0).field(at).to_pylist()]
                new = [redacted(t, s) if s else None for t, s in zip(texts, all_spans(texts, network))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string())], ["row", "new"])

    out = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("new", StringType())]))
    changed = {text: F.col("new")}
    if n_chars in docs.columns:
        changed[n_chars] = F.length("new").cast(docs.schema[n_chars].dataType)
    old = {c: F.col("row").getField(c) for c in docs.columns}
    return out.select(*[(F.coalesce(changed[c], old[c]) if c in changed else old[c]).alias(c) for c in old])
