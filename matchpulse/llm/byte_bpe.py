"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from a rank file.

*Model.* Byte b stands as the character 256 + b, so a vocabulary entry of any bytes is a piece of
text. Pieces lie at the places of their ranks with the negative rank as score; the unknown piece comes after
the last rank. Merging the pair of the highest score is then merging the pair of the lowest rank, the
leftmost of equals. Normalisation is the identity: no prefix, no white space dropped or escaped. The
model is a protocol buffer of few fields, written here; nothing is trained. Entries that merging
alone does not reach are looked up whole, as a rank encoder does.

*Encoding.* A text is cut into the matches of a pattern; each distinct match is encoded once per
task and remembered (up to ``KNOWN`` matches of up to ``KEPT`` characters), so most of a text costs one look-up a match. A long
text is cut in stretches of ``STRETCH`` matches. *Decoding* joins the pieces of the ids and maps their characters back to bytes.

A null text is empty and gives no ids; unknown ids fail the decoding. Repeated rows stay, empty tables stay empty,
columns other than row, doc_id and text are left aside.
"""

from __future__ import annotations

import base64
import codecs
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame

from matchpulse.llm import common as C

KNOWN = 500_000
KEPT = 64
STRETCH = 200_000

#: Field numbers and kinds of the public sentencepiece model format: fixed values.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_KIND, VOCABULARY_SIZE, UNKNOWN_ID, BPE = 3, 4, 40, 2
RULE_NAME, DUMMY_PREFIX, DROP_SPACES, ESCAPE_SPACES = 1, 3, 4, 5

CHARACTERS = "".join(chr(256 + b) for b in range(256))
BYTES = {256 + b: b for b in range(256)}


def as_piece(data: bytes) -> str:
    return codecs.charmap_decode(data, "strict", CHARACTERS)[0]


def as_bytes(piece: str) -> bytes:
    return codecs.charmap_encode(piece, "strict", BYTES)[0]


def read_ranks(path: str) -> dict[bytes, int]:
    """Entries and ranks of a file of lines "base64 rank"; ranks must be 0, 1, 2, ... and hold every byte."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}
    if sorted(ranks.values()) != list(range(len(ranks))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"{path}: ranks must be 0, 1, 2, ... and hold every single byte")
    return ranks


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _whole(field: int, value: int) -> bytes:
    return _number(field << 3) + _number(value)


def _block(field: int, data: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(data)) + data


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece has the id after the last."""

    def piece(text: str, score: float, kind: int) -> bytes:
        fields = _block(PIECE_TEXT, text.encode()) + _number(PIECE_SCORE << 3 | 5) + struct.pack("<f", score) + _whole(PIECE_KIND, kind)
        return _block(PIECES, fields)

    pieces = [piece(as_piece(entry), -rank, NORMAL) for entry, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(piece("<unk>", 0, UNKNOWN))
    trainer = _whole(MODEL_KIND, BPE) + _whole(VOCABULARY_SIZE, len(pieces)) + _whole(UNKNOWN_ID, len(pieces) - 1)
    rules = _block(RULE_NAME, b"identity") + b"".join(_whole(x, 0) for x in (DUMMY_PREFIX, DROP_SPACES, ESCAPE_SPACES))
    return b"".join(pieces) + _block(TRAINER, trainer) + _block(NORMALIZER, rules)


def narrow_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of the first 256 characters, in the faster standard library; None if it holds other escapes.

    The classes \\p{L}, \\p{N}, \\s and \\S are written out as the characters that they hold there.
    """
    held = {x: [i for i in range(256) if regex.match(x, chr(i))] for x in (r"\p{L}", r"\p{N}", r"\s")}
    listed = {x: "".join(f"\\x{i:02x}" for i in own) for x, own in held.items()}
    out, inside = "", False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern):
        if part in listed:
            out += listed[part] if inside else f"[{listed[part]}]"
        elif part == r"\S" and not inside:
            out += "[^" + listed[r"\s"] + "]"
        elif part.startswith("\\"):
            return None
        else:
            inside = part == "[" or (inside and part != "]")
            out += part
    return re.compile(out)


class Known(dict):
    """Packed ids of matches; a match not known counts as a miss and is noted."""

    def __init__(self) -> None:
        self.new: set[str] = set()
        self.misses = 0

    def __missing__(self, match: str) -> bytes:
        self.new.add(match)
        self.misses += 1
        return b""


class Coder:
    """Encoder and decoder of one model."""

    def __init__(self, proto: bytes, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.narrow = narrow_pattern(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        texts = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1)]
        merged = self.model.encode(texts, num_threads=1)
        self.whole = {texts[i]: [i] for i, ids in enumerate(merged) if ids != [i]}
        self.pieces = pa.array([as_bytes(x) for x in texts], pa.large_binary())
        self.numbers = pa.array([b"%d " % i for i in range(len(texts))], pa.large_binary())
        self.known = Known()

    def _learn(self, matches: list[str]) -> None:
        """Remember the ids of matches, as packed bytes."""
        texts = [as_piece(x.encode()) for x in matches]
        found = self.model.encode(texts, num_threads=1)
        if self.whole:
            found = [self.whole.get(x, ids) for x, ids in zip(texts, found)]
        self.known.update((x, array("i", ids).tobytes()) for x, ids in zip(matches, found))

    def _matches(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, a long text's by stretches."""
        pattern = self.pattern
        if self.narrow is not None:
            try:
                text.encode("latin-1")
                pattern = self.narrow
            except UnicodeEncodeError:
                pass
        if len(text) < STRETCH:
            yield pattern.findall(text)
            return
        matches = (m.group() for m in pattern.finditer(text))
        while stretch := list(islice(matches, STRETCH)):
            yield stretch

    def _packed(self, stretches: list[list[str]]) -> list[bytes]:
        """The ids of each stretch as packed 32-bit numbers."""
        if len(self.known) > KNOWN:
            self.known = Known()
        known = self.known
        out = []
        for stretch in stretches:
            before = known.misses
            packed = b"".join(map(known.__getitem__, stretch))
            out.append(packed if known.misses == before else None)
        if known.new:
            new, known.new = list(known.new), set()
            self._learn(new)
            out = [b"".join(map(known.__getitem__, x)) if y is None else y for x, y in zip(stretches, out)]
            for x in new:
                if len(x) > KEPT:
                    del known[x]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 places where texts begin and end."""
        packed, waiting = [[] for _ in range(len(texts))], []

        def settle():
            for (i, _), ids in zip(waiting, self._packed([x for _, x in waiting])):
                packed[i].append(ids)
            waiting.clear()

        for i, text in enumerate(texts.to_pylist()):
            for stretch in self._matches(text or ""):
                waiting.append((i, stretch))
                if len(stretch) >= STRETCH:
                    settle()
        settle()
        edges = np.zeros(len(packed) + 1, np.int64)
        np.cumsum([sum(map(len, x)) // 4 for x in packed], out=edges[1:])
        return np.frombuffer(b"".join(b"".join(x) for x in packed), np.int32), edges

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The bytes of each text."""
        return _between(self.pieces, ids, edges, 0)

    def written(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """Each text's ids in decimal, joined by one space."""
        return _between(self.numbers, ids, edges, 1).cast(pa.string())


def _between(values: pa.Array, ids: np.ndarray, edges: np.ndarray, less: int) -> pa.Array:
    """For each text the values of its ids joined, without the last ``less`` bytes."""
    taken = values.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    offsets = np.frombuffer(offsets, np.int64)[edges] if len(taken) else np.zeros(len(edges), np.int64)
    data = data.to_pybytes() if data is not None else b""
    return pa.array([data[a : max(a, b - less)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())


@lru_cache(maxsize=2)
def _coder(proto: bytes, pattern: str) -> Coder:
    return Coder(proto, pattern)


def _through(table: DataFrame, column: str, ranks_path: str, pattern: str, schema: str, run) -> DataFrame:
    """``run(coder, batch)`` gives the columns of ``schema`` after row and doc_id for batches of about a megabyte of ``column``."""
    proto = table.sparkSession.sparkContext.broadcast(model_proto(read_ranks(ranks_path)))
    schema = f"row bigint, doc_id bigint, {schema}"
    names = [x.split()[0] for x in schema.split(", ")]

    def batches(whole):
        coder = _coder(proto.value, pattern)
        for held in whole:
            for batch in C.slices(held, column) if column == "text" else [held]:
                yield pa.record_batch([batch.column("row"), batch.column("doc_id"), *run(coder, batch)], names)

    return table.select("row", "doc_id", column).mapInArrow(batches, schema)


def encoded(table: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """row, doc_id and the ids (array of int) of every text."""

    def run(coder, batch):
        ids, edges = coder.encode(batch.column("text"))
        return [C.lists(pa.array(ids), np.diff(edges))]

    return _through(table, "text", ranks_path, pattern, "ids array<int>", run)


def decoded(table: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """row, doc_id and the bytes (decoded) that the ids of every row stand for; null ids stand for none."""

    def run(coder, batch):
        ids = batch.column("ids")
        edges = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), out=edges[1:])
        return [coder.decode(ids.flatten().to_numpy(), edges)]

    return _through(table, "ids", ranks_path, pattern, "decoded binary", run)


def round_trip(table: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """row, doc_id, n_tokens, ids_text (decimal, joined by spaces) and the bytes decoded from these ids, in one pass."""

    def run(coder, batch):
        ids, edges = coder.encode(batch.column("text"))
        return [pa.array(np.diff(edges)), coder.written(ids, edges), coder.decode(ids, edges)]

    return _through(table, "text", ranks_path, pattern, "n_tokens bigint, ids_text string, decoded binary", run)
