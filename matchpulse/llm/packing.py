"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Tasks tokenize whole texts and cut only those longer than a sequence. What decides the packing is
the number of pieces of each length, at most ``capacity`` numbers whatever the input; they are
packed on the driver, longest first, each into the open bin with the least room that holds it. A segment
tree over remaining capacities finds that bin. Pieces of equal length behave alike, so they are
placed in runs, which gives the same bins as one by one. Pieces then look up their place by length
and number; token ids never leave their task.

Ids come from tiktoken, except for runs of ``LONG_RUN`` white-space characters or more, at which its pattern
matcher gives up (at some 1,000,000): the tokenizers library encodes those, tiktoken what lies between.

A null text is empty and has only the end token. Rows are separate documents. Any numbers of
sequences are given out without gaps; an empty table has none.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchpulse.sources.staging import staged

CAPACITY = 1024
END = 2
LONG_RUN = 200_000
#: What ``\s`` of the pattern matches; Python's own has the four separators 1C to 1F besides.
WHITE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

PIECES = (
    "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint"
)
KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())


def byte_of_letter() -> dict[str, int]:
    """The byte for each letter that byte-level vocabularies write: printable ones stand for themselves,
    the others are moved beyond 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=2)
def encoder(path: str | None):
    """An encoder for a byte-level BPE file (JSON of the tokenizers library), the same ids but faster."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        described = json.load(file)
    special = {x["content"]: x["id"] for x in described["added_tokens"]}
    letters = byte_of_letter()
    ranks = {
        bytes(letters[c] for c in token): number
        for token, number in described["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def run_encoder(path: str | None):
    """The tokenizers library's own encoder for the same file."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))


def long_runs(text: str, special: set[str]) -> list[tuple[int, int]]:
    """Starts and ends of the tokens of the pattern that are white space of LONG_RUN characters or more.

    Such a token leaves the last character of its run to what follows, unless that is the end or a special token.
    """
    half = LONG_RUN // 2  # a long run holds one of the blocks of half its size
    if len(text) < LONG_RUN or not any(text[i : i + half].isspace() for i in range(0, len(text), half)):
        return []
    out = []
    for start, end in (x.span() for x in WHITE_RUN.finditer(text)):
        if end - start >= LONG_RUN:
            whole = end == len(text) or any(text.startswith(x, end) for x in special)
            out.append((start, end if whole else end - 1))
    return out


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    """The ids of a text and the end token, as little-endian 32-bit numbers."""
    if not text:
        return np.array([END], "<u4")
    fast, out, done = encoder(path), [], 0
    for start, end in long_runs(text, fast.special_tokens_set):
        out.append(fast.encode_to_numpy(text[done:start], allowed_special="all"))
        out.append(run_encoder(path).encode(text[start:end], add_special_tokens=False).ids)
        done = end
    out.append(fast.encode_to_numpy(text[done:] if done else text, allowed_special="all"))
    return np.concatenate([*out, [END]]).astype("<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of n tokens; only the first may be shorter than a sequence."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((i, capacity) for i in range(first, n, capacity))]


def pieces(documents: DataFrame, path: str | None, capacity: int) -> DataFrame:
    """The pieces of every document, numbered by length within each task's part of the table."""

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        out = []
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(name) for name in ("row", "doc_id", "text"))):
                ids = token_ids(text.as_py(), path)
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    out.append((row.as_py(), doc_id.as_py(), i, start, length, crc, part, seen[length]))
                    seen[length] += 1
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return documents.select("row", "doc_id", "text").mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), KINDS)], names)


class RoomTree:
    """Segment tree over remaining capacities: which of them an open bin has."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, count: int) -> None:
        """Open ``count`` bins from ``first`` on with so much room."""
        self.bins.setdefault(room, []).append((first, count))
        self._set(room, True)

    def take(self, room: int) -> tuple[int, int]:
        own = self.bins[room]
        taken = own.pop()
        if not own:
            self._set(room, False)
        return taken

    def tightest(self, least: int) -> int | None:
        """The least room of an open bin that is at least ``least``."""
        at = least + self.size
        while not self.any[at]:
            while at & 1:  # a right child: nothing further right below its parent
                at >>= 1
                if at == 0:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size

    def _set(self, room: int, value: bool) -> None:
        at = room + self.size
        self.any[at] = value
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]


def packing_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first number, pieces per bin, first bin, offset) that place all pieces.

    Piece number k of a length, in the run that begins at f, goes to bin first bin + (k - f) // per bin.
    """
    tree, bins, runs = RoomTree(capacity), 0, []
    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, bins
                count = -(-left // (capacity // length))
                bins += count
            else:
                first, count = tree.take(room)
            each = room // length
            full, rest = divmod(min(left, count * each), each)
            runs.append((length, number, each, first, capacity - room))
            for begin, size, new in (
                (first, full, room - each * length),
                (first + full, 1 if rest else 0, room - rest * length),
                (first + full + (rest > 0), count - full - (rest > 0), room),
            ):
                if size:
                    tree.put(new, begin, size)
            number += full * each + rest
            left -= full * each + rest
    return np.array(runs, np.int64).reshape(-1, 5)


def packed(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. Needs row, doc_id, text."""
    table = staged(pieces(documents, path, capacity), "packing-pieces")
    by_part = table.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = staged(by_part.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "packing-firsts")
    counts = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = table.sparkSession.sparkContext.broadcast(packing_plan(counts, capacity))

    def run(batches):
        lengths, firsts_of, each, bins, offsets = plan.value.T
        key = (capacity - lengths) << 48 | firsts_of  # runs come longest first
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy() + batch.column("first").to_numpy()
            at = np.searchsorted(key, (capacity - length) << 48 | number, "right") - 1
            step = number - firsts_of[at]
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(bins[at] + step // each[at], pa.int64()),
                    pa.array(offsets[at] + step % each[at] * length, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    placed = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return table.join(firsts.drop("n"), ["part", "length"]).mapInArrow(run, placed)
