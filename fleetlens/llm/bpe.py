"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

Encoding reads the pre-tokens of a text one after the other, each byte by byte: a token sequence is the encoding exactly
if every two neighbours are the encoding of their joined bytes, so each prefix has one last token, found among the tokens
that end there. The merge list's sufficient lookahead is its longest token: no token that ends after byte n starts before
n + 1 - longest, so whatever follows builds on one of the prefixes that end in the last ``longest`` bytes. Where the paths
of all of these meet, the tokens before are stable; they are emitted and forgotten, so memory does not grow with the
pre-token. Of a short pre-token only the prefixes that its end rests on are looked at; what came out is remembered in a bounded table. Merging itself (``merged``) only decides
which two tokens may be neighbours.

Decoding feeds token bytes to an incremental UTF-8 state machine, which holds back an unfinished character; what can't
be a character becomes U+FFFD.

Spark deals the documents out as they are stored: no shuffle, no state between tasks. Defined cases: a null text is the
empty one, with no tokens; texts of any length go through whole; repeated rows are encoded each; an empty table gives
an empty one; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map

#: Fixed values of the vocabulary's format: contractions, letters, numbers, others, white space.
PRE_TOKENS = r""" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

SHORT, REMEMBERED, FLUSH, CHUNK, NONE = 256, 400_000, 4096, 65_536, 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The format writes bytes as letters: printable Latin-1 as it is, the others from U+0100 on in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        ids = {spell(token): i for token, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = ids
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for spelled, i in ids.items():
            self.bytes[i] = spelled
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.names = [str(i) for i in range(size)]
        self.single = [ids[bytes([b])] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made = [ids[spell(a) + spell(b)] for a, b in pairs]
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault((ids[spell(a)], ids[spell(b)]), rank)
        self.lookahead = max([1, *(len(self.bytes[i]) for i in self.made)])
        made = set(self.made)
        self.endings: dict = {}  # tokens by their bytes from the last to the first
        for spelled, i in ids.items():
            if len(spelled) == 1 or i in made:
                node = self.endings
                for byte in reversed(spelled):
                    node = node.setdefault(byte, {})
                node[-1] = i
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pre_tokens = regex.compile(PRE_TOKENS)
        self.fits: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.known = _Remembered(self)

    def merged(self, piece: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost first."""
        tokens = [self.single[b] for b in piece]
        get, made = self.ranks.get, self.made
        ranks = [get(pair, NONE) for pair in zip(tokens, tokens[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == NONE:
                break
            i = ranks.index(lowest)
            tokens[i] = made[lowest]
            del tokens[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((tokens[i], tokens[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((tokens[i - 1], tokens[i]), NONE)
        return tokens

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes."""
        key = (a, b)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            found = self.fits[key] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """Tokens of the bytes, each as soon as nothing that may follow can change it; memory stays constant."""
        longest, endings, fits = self.lookahead, self.endings, self.fits
        held = bytearray()  # bytes since the end of the last token emitted
        last: list[int | None] = [None]  # last[i]: the last token of the prefix that ends at held[i]
        before: int | None = None  # the last token emitted
        since = 0
        for byte in piece:
            held.append(byte)
            end = len(held)
            start, node = end - 1, endings[byte]  # each byte is a token
            found = []
            while True:
                if -1 in node:
                    previous = last[start] if start else before
                    if previous is not None or not start:
                        found.append((previous, node[-1]))
                if not start:
                    break
                start -= 1
                node = node.get(held[start])
                if node is None:
                    break
            chosen = None
            while found:  # the longest first; only one fits
                pair = found.pop()
                if pair[0] is None:
                    fit = True
                else:
                    fit = fits.get(pair)
                    if fit is None:
                        fit = self.neighbours(*pair)
                if fit and self.merged_alone(pair[1]):
                    chosen = pair[1]
                    break
            last.append(chosen)
            since += 1
            if since >= FLUSH:
                since = 0
                cut = self._meeting_point(last, end, longest)
                if cut:
                    done = self._path(last, cut)
                    yield from done
                    before = done[-1]
                    del held[:cut]
                    last = [None, *last[cut + 1 :]]
        if held:
            yield from self._path(last, len(held))

    def ended(self, piece: bytes) -> list[int]:
        """What :meth:`stream` gives for a piece that ends within the lookahead's buffer, so nothing more can follow.

        The transducer's state is then asked for at the end alone, and for those prefixes that the answer rests on.
        """
        last: dict[int, int | None] = {}
        self._last(piece, len(piece), last)
        return self._path(last, len(piece))

    def _last(self, piece: bytes, end: int, last: dict[int, int | None]) -> int | None:
        """The last token of the prefix up to ``end``, the longest that fits behind the prefix before it."""
        start, node = end - 1, self.endings[piece[end - 1]]
        found = []
        while True:
            if -1 in node:
                found.append((start, node[-1]))
            if not start:
                break
            start -= 1
            node = node.get(piece[start])
            if node is None:
                break
        chosen = None
        for start, token in reversed(found):
            if start:
                previous = last[start] if start in last else self._last(piece, start, last)
                if previous is None:
                    continue
                fit = self.fits.get((previous, token))
                if not (self.neighbours(previous, token) if fit is None else fit):
                    continue
            if self.merged_alone(token):
                chosen = token
                break
        last[end] = chosen
        return chosen

    def merged_alone(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = len(self.merged(self.bytes[token])) == 1
        return found

    def _path(self, last: list[int | None] | dict[int, int | None], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes[last[end]])
        return out[::-1]

    def _meeting_point(self, last: list[int | None], end: int, longest: int) -> int:
        """The last position that the paths of all prefixes that can still grow go through."""
        live = {i for i in range(max(0, end + 1 - longest), end + 1) if i == 0 or last[i] is not None}
        while len(live) > 1:
            furthest = max(live)
            live.discard(furthest)
            live.add(furthest - len(self.bytes[last[furthest]]))
        return live.pop()

    def encode(self, text: str) -> list[int]:
        """All tokens of a text."""
        return list(self.tokens(text))

    def tokens(self, text: str) -> Iterator[int]:
        """The tokens one by one; short parts are split at once, long ones as they are read."""
        parts = self.split.split(text) if self.split is not None else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif part:
                pieces = self.pre_tokens.findall(part) if len(part) <= CHUNK else map(_whole, self.pre_tokens.finditer(part))
                yield from chain.from_iterable(map(self.known.__getitem__, pieces))

    def decode(self, tokens: Iterable[int]) -> Iterator[str]:
        """The text of the tokens, piece by piece."""
        machine, tokens = codecs.getincrementaldecoder("utf-8")("replace"), iter(tokens)
        while chunk := b"".join(map(self.bytes.__getitem__, islice(tokens, CHUNK))):
            yield machine.decode(chunk)
        yield machine.decode(b"", True)


class _Remembered(dict):
    """Tokens of pre-tokens by the transducer; those of short ones are kept for two generations of a bounded size."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary, self.before = vocabulary, {}

    def __missing__(self, piece: str) -> Iterable[int]:
        found = self.before.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "replace")
            if len(raw) > SHORT:
                return self.vocabulary.stream(raw)
            found = tuple(self.vocabulary.ended(raw))
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[piece] = found
        return found


_whole = regex.Match.group


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document: id, ids (its tokens)."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_vocabulary())  # the executor's own file
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = pa.array([v.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    return arrow_map(rows, run, f"id {kind}, ids array<int>").select(F.col("id").alias(id), "ids")


def decode_documents(tokens: DataFrame, id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Per document: id, text."""
    rows = tokens.select(F.col(id).alias("id"), F.col(ids).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_vocabulary())  # the executor's own file
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = pa.array(["".join(v.decode(x or ())) for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["id", "text"])

    return arrow_map(rows, run, f"id {kind}, text string").select(F.col("id").alias(id), "text")


def round_trips(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256. Tokens are counted, hashed and decoded as they come."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def digests(v: Vocabulary, body: str) -> tuple[int, str, str]:
        n, ids, out = 0, hashlib.sha256(), hashlib.sha256()
        machine, tokens = codecs.getincrementaldecoder("utf-8")("replace"), v.tokens(body)
        while chunk := list(islice(tokens, CHUNK)):
            ids.update(("," * (n > 0) + ",".join(map(v.names.__getitem__, chunk))).encode())
            n += len(chunk)
            out.update(machine.decode(b"".join(map(v.bytes.__getitem__, chunk))).encode())
        out.update(machine.decode(b"", True).encode())
        return n, ids.hexdigest(), out.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_vocabulary())  # the executor's own file
        for batch in batches:
            found = [digests(v, t.as_py()) for t in batch.column(1)]
            n, a, b = zip(*found) if found else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(rows, run, schema).withColumnRenamed("id", id)
