"""External induced sorting of suffixes with their common prefixes, in memory that is a parameter.

Suffixes are sorted from their ends: a tuple (head, rank of what follows the head) decides the order of
a longer suffix from the order of the shorter one, level by level. As texts are windows of one width, the recursion
on the suffixes that follow has as many levels as a window has heads. A level's tuples wait in a
priority queue that spills sorted runs to disk and merges them when popped, and carry the text still to come
in front of them. The length of the common prefix of neighbours is carried along: equal heads add
the head's size to the least common prefix between the two ranks one level below, which is looked up in that level's
prefixes on disk.

Held in memory are up to ``limit`` tuples (some multiples while they are sorted), and 4 bytes for each ``SPAN`` suffixes.
Orders go out block by block. Spill files live in a folder of the task and go with it, like Spark's own.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

LIMIT = 200_000
BLOCK = 20_000
HEAD = 8
SPAN = 4096


class TupleQueue:
    """Priority queue of tuples by (head, rank), on disk beyond ``limit`` of them."""

    def __init__(self, kind: np.dtype, folder: str, limit: int) -> None:
        self.kind, self.folder, self.limit = kind, folder, limit
        self.held: list[np.ndarray] = []
        self.count = 0
        self.runs: list = []

    def push(self, tuples: np.ndarray) -> None:
        self.held.append(tuples)
        self.count += len(tuples)
        if self.count > self.limit:
            run = tempfile.TemporaryFile(dir=self.folder)
            self._sorted().tofile(run)
            run.seek(0)
            self.runs.append(run)

    def _sorted(self) -> np.ndarray:
        tuples = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        self.held, self.count = [], 0
        return tuples[np.lexsort((tuples["rank"], tuples["head"]))]

    def pop(self) -> Iterator[np.ndarray]:
        """All tuples in order, in blocks; the queue is empty afterwards."""
        last = self._sorted()
        if not self.runs:
            for i in range(0, len(last), BLOCK):
                yield last[i : i + BLOCK]
            return
        size = max(1, min(BLOCK, self.limit // (len(self.runs) + 1)))
        fronts = [last, *(self._read(run, size) for run in self.runs)]
        sources = [None, *self.runs]
        while any(len(front) for front in fronts):
            # up to the least last tuple of a front that goes on, everything is in memory
            ends = [f[-1] for f, s in zip(fronts, sources) if len(f) and s is not None]
            end = min(((e["head"], e["rank"]) for e in ends), default=None)
            ready = []
            for i, front in enumerate(fronts):
                n = len(front)
                if end is not None:
                    n = int(((front["head"] < end[0]) | ((front["head"] == end[0]) & (front["rank"] <= end[1]))).sum())
                ready.append(front[:n])
                fronts[i] = front[n:]
                if not len(fronts[i]) and sources[i] is not None:
                    fronts[i] = self._read(sources[i], size)
            out = np.concatenate(ready)
            yield out[np.lexsort((out["rank"], out["head"]))]
        for run in self.runs:
            run.close()
        self.runs = []

    def _read(self, run, size: int) -> np.ndarray:
        return np.frombuffer(run.read(size * self.kind.itemsize), self.kind)


class LeastBetween:
    """Least value between two places of an array on disk, for many pairs of places at once.

    Values are appended, then asked for. Held are the least of each ``SPAN`` values and, while answering, one span.
    """

    def __init__(self, folder: str) -> None:
        self.file = tempfile.TemporaryFile(dir=folder)
        self.rest, self.spans = np.zeros(0, np.int32), [np.zeros(0, np.int32)]

    def append(self, values: np.ndarray) -> None:
        values = values.astype(np.int32)
        self.file.write(values.tobytes())
        values = np.concatenate([self.rest, values])
        whole = len(values) // SPAN * SPAN
        self.spans.append(values[:whole].reshape(-1, SPAN).min(axis=1))
        self.rest = values[whole:]

    def finish(self) -> LeastBetween:
        last = [np.array([self.rest.min()], np.int32)] if len(self.rest) else []
        self.levels = _levels(np.concatenate([*self.spans, *last]))
        self.file.flush()
        return self

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of the values first..last, both included."""
        out = np.full(len(first), np.iinfo(np.int32).max, np.int32)
        a, b = first // SPAN, last // SPAN
        far = np.flatnonzero(b - a > 1)
        out[far] = _least(self.levels, a[far] + 1, b[far] - 1)
        by_first, by_last = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        for span in np.unique(np.concatenate([a, b])).tolist():
            values = np.frombuffer(os.pread(self.file.fileno(), 4 * SPAN, 4 * SPAN * span), np.int32)
            own = by_first[np.searchsorted(a[by_first], span) : np.searchsorted(a[by_first], span, "right")]
            inside, own = own[b[own] == span], own[b[own] != span]
            if len(inside):
                out[inside] = _least(_levels(values), first[inside] - span * SPAN, last[inside] - span * SPAN)
            if len(own):
                to_end = np.minimum.accumulate(values[::-1])[::-1]
                out[own] = np.minimum(out[own], to_end[first[own] - span * SPAN])
            own = by_last[np.searchsorted(b[by_last], span) : np.searchsorted(b[by_last], span, "right")]
            own = own[a[own] != span]
            if len(own):
                out[own] = np.minimum(out[own], np.minimum.accumulate(values)[last[own] - span * SPAN])
        return out


def _levels(values: np.ndarray) -> list[np.ndarray]:
    """The least of each 1, 2, 4, ... values."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        below, step = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.minimum(below[:-step], below[step:]))
    return levels


def _least(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    level = np.frexp(last - first + 1)[1] - 1
    out = np.zeros(len(first), np.int32)
    for k in np.unique(level).tolist():
        own = level == k
        out[own] = np.minimum(levels[k][first[own]], levels[k][last[own] - 2**k + 1])
    return out


def heads_of(texts: np.ndarray) -> np.ndarray:
    """Columns of at most HEAD bytes as numbers that sort like the bytes."""
    wide = np.zeros((len(texts), HEAD), np.uint8)
    wide[:, : texts.shape[1]] = texts
    return wide.view(">u8").ravel().astype(np.uint64)


def equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes two heads share."""
    differ = (a ^ b).astype(">u8").view(np.uint8).reshape(-1, HEAD) != 0
    return np.where(differ.any(axis=1), differ.argmax(axis=1), HEAD)


def suffix_orders(
    batches: Iterable[tuple[np.ndarray, np.ndarray]],
    width: int,
    wanted: list[int],
    folder: str,
    payload: np.dtype | str = "i8",
    limit: int = LIMIT,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Orders of the suffixes that begin at given columns of texts of ``width`` bytes.

    ``batches`` are (payloads, texts as a matrix of bytes). For each column in ``wanted``, from the last to the first, and
    block by block: (column, payloads in the order of their suffixes, common prefix of each suffix with the one before).
    """
    cuts, at = [], width
    for column in sorted(wanted, reverse=True):
        while at > column:
            at = max(column, at - HEAD)
            cuts.append(at)
    kind = np.dtype([("head", "u8"), ("rank", "i8"), ("payload", payload), ("text", "u1", (width,))])
    ends = [width, *cuts[:-1]]

    def tuples(payloads, texts, rank, level):
        out = np.empty(len(payloads), kind)
        out["payload"], out["text"], out["rank"] = payloads, texts, rank
        out["head"] = heads_of(texts[:, cuts[level] : ends[level]])
        return out

    queue = TupleQueue(kind, folder, limit)
    for payloads, texts in batches:
        for i in range(0, len(payloads), limit):
            queue.push(tuples(payloads[i : i + limit], texts[i : i + limit], 0, 0))
    below = None
    for level, (begin, end) in enumerate(zip(cuts, ends)):
        following, prefixes = TupleQueue(kind, folder, limit), LeastBetween(folder)
        done, last = 0, None
        for block in queue.pop():
            joined = block if last is None else np.concatenate([last, block])
            a, b = joined[:-1], joined[1:]
            shared = np.minimum(equal_bytes(a["head"], b["head"]), end - begin).astype(np.int32)
            whole = np.flatnonzero(shared == end - begin)
            if below is not None and len(whole):
                shared[whole] += below(a["rank"][whole] + 1, b["rank"][whole])
            common = shared if last is not None else np.concatenate([np.zeros(1, np.int32), shared])
            prefixes.append(common)
            if level + 1 < len(cuts):
                following.push(tuples(block["payload"], block["text"], np.arange(done, done + len(block)), level + 1))
            done += len(block)
            last = block[-1:].copy()
            if begin in wanted:
                yield begin, block["payload"], common
        below, queue = prefixes.finish(), following
