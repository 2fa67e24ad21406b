"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public: the pieces of a sentencepiece file, lower-cased, and every single
byte. Each language gives each piece a probability; a word's probability is the sum over
all ways to cut it into pieces, found by the forward algorithm. Piece probabilities come from one round of
expectation maximisation over all training texts: expected piece counts of every word under equal
probabilities, by the forward-backward algorithm, summed per language.

Words are lower-cased runs of letters and of everything beyond ASCII, and begin with a mark. A run
over ``WORD`` bytes is parted where no piece can cross, so that the product over its parts is the sum over all
its segmentations; a part still over ``WORD`` bytes is summed in logarithms. Within a slice of a task each distinct
word or part is cut once: numpy steps go through a trie for all words of one length together. What tasks send is a
count per language and piece. Any number of languages is scored, in blocks of ``BLOCK``; the model holds the
pieces that each language was seen with, so rare labels take little room.

A null text or one without a letter is ``und`` with score 0, as is any text when nothing could be learned.
Null langs and ids are not learned from. Ties go to the first language in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchpulse.llm import common as C

MARK = 32
WORD = 24
SLICE = 4_000_000
PLACES = 1_000_000
BLOCK = 64
SMOOTHING = 0.5
LEAST_PROBABILITY = 1e-10
UNKNOWN = "und"

LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = True
LETTERS[128:] = True


def vocabulary(path: str | None = None) -> tuple[bytes, ...]:
    """The pieces of a sentencepiece file that words can hold, and all single bytes; sorted."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).lower()
            letters = piece.removeprefix("▁")
            if letters.isalpha():
                found.add(piece.replace("▁", chr(MARK)).encode())
    return tuple(sorted(found))


class Trie:
    """The pieces as a table of steps: child[node, class of byte], and the piece that ends at a node."""

    def __init__(self, pieces: tuple[bytes, ...]) -> None:
        used = sorted({b for x in pieces if len(x) > 1 for b in x})
        self.class_of = np.zeros(256, np.int64)
        self.class_of[used] = np.arange(1, len(used) + 1)
        nodes: dict[bytes, int] = {}
        for x in pieces:
            for i in range(1, len(x) + 1):
                nodes.setdefault(x[:i], len(nodes) + 1)
        self.first = np.zeros(256, np.int32)
        self.child = np.zeros((len(nodes) + 1, len(used) + 1), np.int32)
        for x, node in nodes.items():
            if len(x) == 1:
                self.first[x[0]] = node
            else:
                self.child[nodes[x[:-1]], self.class_of[x[-1]]] = node
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[[nodes[x] for x in pieces]] = np.arange(len(pieces))
        self.longest = max(map(len, pieces))

    def cuts(self, words: np.ndarray, backwards: bool = False):
        """(start, end, rows, pieces) of all pieces in a matrix of words of one length, by start."""
        classes = self.class_of[words]
        size = words.shape[1]
        for start in range(size)[:: -1 if backwards else 1]:
            node, rows = self.first[words[:, start]], np.arange(len(words))
            for end in range(start + 1, min(start + self.longest, size) + 1):
                piece = self.piece[node]
                hit = piece >= 0
                if hit.any():
                    yield start, end, rows[hit], piece[hit]
                if end == size:
                    break
                node = self.child[node, classes[rows, end]]
                alive = node > 0
                node, rows = node[alive], rows[alive]
                if not len(rows):
                    break

    def _reach(self, data: np.ndarray, node: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Where the longest piece ends whose walk stands at ``node`` after the byte at ``at``; at + 1 if none does."""
        reach, rows = at + 1, np.arange(len(at))
        for step in range(self.longest):
            rows, node = rows[node > 0], node[node > 0]
            hit = rows[self.piece[node] >= 0]
            reach[hit] = at[hit] + step + 1
            more = at[rows] + step + 1 < limit[rows]
            rows, node = rows[more], node[more]
            if not len(rows):
                break
            node = self.child[node, self.class_of[data[at[rows] + step + 1]]]
        return reach

    def partings(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places inside marked runs of bytes that no piece crosses."""
        sizes = ends - starts
        before = np.cumsum(sizes) - sizes
        out, far = [np.zeros(0, np.int64)], 0
        for a in range(0, int(sizes.sum()), PLACES):
            place = np.arange(a, min(a + PLACES, int(sizes.sum())))
            run = np.searchsorted(before, place, "right") - 1
            at, limit = starts[run] + place - before[run], ends[run]
            reach = self._reach(data, self.first[data[at]], at, limit)
            head = np.flatnonzero(place == before[run])
            marked = self.child[self.first[MARK], self.class_of[data[at[head]]]]
            reach[head] = np.maximum(reach[head], self._reach(data, marked, at[head], limit[head]))
            furthest = np.maximum.accumulate(np.r_[far, reach])
            out.append(at[(furthest[:-1] <= at) & (place != before[run])])
            far = furthest[-1]
        return np.concatenate(out)


@lru_cache(maxsize=2)
def trie_of(pieces: tuple[bytes, ...]) -> Trie:
    return Trie(pieces)


def forward(trie: Trie, words: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Sum over all segmentations of each word, per language: rows of words, columns of probability."""
    total = np.zeros((words.shape[1] + 1, len(words), probability.shape[1]))
    total[0] = 1
    for start, end, rows, pieces in trie.cuts(words):
        total[end, rows] += total[start, rows] * probability[pieces]
    return total[-1]


def forward_logs(trie: Trie, words: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Logarithms of ``forward`` for words of any length; only the sums that a piece can still reach are held."""
    ring = trie.longest + 1
    total = np.full((ring, len(words), probability.shape[1]), -np.inf)
    total[0] = at = 0
    for start, end, rows, pieces in trie.cuts(words):
        if start != at:
            total[at % ring] = -np.inf
            at = start
        more = total[start % ring, rows] + np.log(probability[pieces])
        total[end % ring, rows] = np.logaddexp(total[end % ring, rows], more)
    return total[words.shape[1] % ring]


def log_sums(trie: Trie, words: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """The logarithm of the sum over all segmentations of each word, per language."""
    if words.shape[1] > WORD + 1:
        return forward_logs(trie, words, probability)
    return np.log(forward(trie, words, probability))


def expected_counts(trie: Trie, words: np.ndarray, weights: np.ndarray, probability: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces, and their expected counts in each word times its weight, when all pieces are equally likely."""
    if words.shape[1] > WORD + 1:
        return _expected_counts_logs(trie, words, weights, np.log(probability))
    ahead = np.zeros((words.shape[1] + 1, len(words)))
    back = np.zeros_like(ahead)
    ahead[0] = back[-1] = 1
    cuts = list(trie.cuts(words))
    for start, end, rows, _ in cuts:
        ahead[end, rows] += ahead[start, rows] * probability
    for start, end, rows, _ in reversed(cuts):
        back[start, rows] += back[end, rows] * probability
    scale = weights * probability / ahead[-1]
    pieces = [pieces for _, _, _, pieces in cuts]
    shares = [ahead[start, rows] * back[end, rows] * scale[rows] for start, end, rows, _ in cuts]
    return np.concatenate(pieces), np.concatenate(shares)


def _expected_counts_logs(trie: Trie, words: np.ndarray, weights: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The same by logarithms, for words of any length; sums are held for places, not for pieces."""
    ahead = np.full((words.shape[1] + 1, len(words)), -np.inf)
    back = ahead.copy()
    ahead[0] = back[-1] = 0
    for start, end, rows, _ in trie.cuts(words):
        ahead[end, rows] = np.logaddexp(ahead[end, rows], ahead[start, rows] + step)
    counts = np.zeros(trie.piece.max() + 1)
    for start, end, rows, pieces in trie.cuts(words, backwards=True):
        after = back[end, rows] + step
        back[start, rows] = np.logaddexp(back[start, rows], after)
        np.add.at(counts, pieces, np.exp(ahead[start, rows] + after - ahead[-1, rows]) * weights[rows])
    found = np.flatnonzero(counts)
    return found, counts[found]


class Words:
    """The distinct words of the texts of an Arrow column; those over WORD bytes in parts that no piece crosses."""

    def __init__(self, trie: Trie, column: pa.Array, group: np.ndarray | None = None) -> None:
        """group: a number for each text; equal words of different groups are kept apart."""
        self.data, offsets = C.flat(column)
        starts, ends = C.words(self.data, LETTERS)
        counts = np.diff(np.searchsorted(starts, offsets))
        self.owners = np.repeat(np.arange(len(column)), counts)
        long = ends - starts > WORD
        begin = np.sort(np.concatenate([starts, trie.partings(self.data, starts[long], ends[long])]))
        which = np.searchsorted(starts, begin, "right") - 1
        end = np.minimum(np.append(begin[1:], len(self.data)), ends[which])
        inner = begin != starts[which]
        self.owners = self.owners[which]
        keys = C.word_hashes(self.data, begin, end) ^ C.mixed(inner.astype(C.U) + C.U(1))
        if group is not None:
            keys ^= C.mixed(group[self.owners].astype(C.U) + C.U(7))
        _, self.at, self.word, self.times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        self.begin, self.size, self.marked = begin[self.at], (end - begin)[self.at], ~inner[self.at]

    def matrices(self):
        """(rows of the distinct words, matrix of their bytes) for words of one length."""
        kind = self.size * 2 + self.marked
        order = np.argsort(kind, kind="stable")
        edges = np.flatnonzero(np.r_[True, kind[order][1:] != kind[order][:-1], True]) if len(order) else []
        for a, b in zip(edges[:-1], edges[1:]):
            rows = order[a:b]
            size, marked = int(self.size[rows[0]]), bool(self.marked[rows[0]])
            words = self.data[self.begin[rows][:, None] + np.arange(size)]
            if marked:
                words = np.concatenate([np.full((len(rows), 1), MARK, np.uint8), words], axis=1)
            yield rows, words


@dataclass
class Model:
    """Languages in alphabetical order, their log shares, and the counts n of pieces seen in them, by language."""

    pieces: tuple[bytes, ...]
    languages: list[str]
    shares: np.ndarray
    piece: np.ndarray
    language: np.ndarray
    n: np.ndarray

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """The first language and probability[piece, language] of each block of languages."""
        for first in range(0, len(self.languages), BLOCK):
            a, b = np.searchsorted(self.language, [first, first + BLOCK])
            counts = np.full((len(self.pieces), min(BLOCK, len(self.languages) - first)), SMOOTHING)
            np.add.at(counts, (self.piece[a:b], self.language[a:b] - first), self.n[a:b])
            yield first, np.maximum(counts / counts.sum(axis=0), LEAST_PROBABILITY)


def piece_counts(texts: DataFrame, pieces: tuple[bytes, ...]) -> DataFrame:
    """lang, piece, n: expected counts over all texts; tasks hold at most 2 * BLOCK languages before they send them."""
    shared = texts.sparkSession.sparkContext.broadcast(pieces)

    def sums(totals):
        for name, counts in totals.items():
            piece = np.flatnonzero(counts)
            columns = [pa.array([name] * len(piece), pa.string()), pa.array(piece, pa.int32()), pa.array(counts[piece])]
            yield pa.record_batch(columns, ["lang", "piece", "n"])

    def run(batches):
        trie = trie_of(shared.value)
        size = len(shared.value)
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in C.slices(whole, "text", SLICE):
                coded = batch.column("lang").dictionary_encode()
                group, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                words = Words(trie, batch.column("text"), group)
                language = group[words.owners[words.at]] if len(words.at) else np.zeros(0, np.int64)
                for first in range(0, len(names), BLOCK):
                    block = names[first : first + BLOCK]
                    counts = np.zeros(size * len(block))
                    for rows, matrix in words.matrices():
                        for k in range(len(block)):
                            own = language[rows] == first + k
                            if own.any():
                                found, weight = expected_counts(trie, matrix[own], words.times[rows[own]], 1 / size)
                                counts[k * size : (k + 1) * size] += np.bincount(found, weight, size)
                    for k, name in enumerate(block):
                        totals[name] = totals.get(name, 0) + counts[k * size : (k + 1) * size]
                    if len(totals) > BLOCK:
                        yield from sums(totals)
                        totals = {}
        yield from sums(totals)

    found = texts.select("lang", "text").mapInArrow(run, "lang string, piece int, n double")
    return found.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, train: Column, path: str | None = None) -> Model:
    """A model learned from text and lang of the rows for which ``train`` holds."""
    pieces = vocabulary(path)
    rows = documents.where("text IS NOT NULL AND lang IS NOT NULL").where(F.coalesce(train, F.lit(False)))
    rows = rows.select("lang", F.lower("text").alias("text"))
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(texts)
    place = {name: i for i, name in enumerate(languages)}
    found = piece_counts(rows, pieces).toPandas()
    piece, language = found["piece"].to_numpy(np.int32), found["lang"].map(place).to_numpy(np.int32)
    order = np.argsort(language, kind="stable")
    shares = np.array([texts[x] for x in languages], np.float64)
    shares = np.log(shares / shares.sum()) if languages else shares
    return Model(pieces, languages, shares, piece[order], language[order], found["n"].to_numpy()[order])


def identified(documents: DataFrame, model: Model) -> DataFrame:
    """All columns but text, with lang_pred and score, for rows of text and further columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    others = [c for c in documents.columns if c != "text"]
    lettered = documents.select(*others, F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")).alias("text"))

    def run(batches):
        model = shared.value
        trie = trie_of(model.pieces)
        held = list(model.blocks()) if len(model.languages) <= BLOCK else None
        for whole in batches:
            for batch in C.slices(whole, "text", SLICE):
                words = Words(trie, batch.column("text"))
                best, top, mass = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, -np.inf), np.zeros(batch.num_rows)
                for first, probability in model.blocks() if held is None else held:
                    logs = np.zeros((len(words.at), probability.shape[1]))
                    for rows, matrix in words.matrices():
                        logs[rows] = log_sums(trie, matrix, probability)
                    likely = np.column_stack(
                        [np.bincount(words.owners, logs[words.word, k], batch.num_rows) for k in range(logs.shape[1])]
                    )
                    likely += model.shares[first : first + BLOCK]
                    highest = np.maximum(top, likely.max(axis=1))
                    best = np.where(highest > top, first + likely.argmax(axis=1), best)
                    mass = mass * np.exp(top - highest) + np.exp(likely - highest[:, None]).sum(axis=1)
                    top = highest
                known = np.asarray(batch.column("text").is_valid()) & bool(model.languages)
                score = np.divide(1, mass, out=np.zeros(batch.num_rows), where=known)
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                columns = [batch.column(c) for c in others]
                yield pa.record_batch([*columns, pa.array(names, pa.string()), pa.array(score)], [*others, "lang_pred", "score"])

    schema = documents.select(*others, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return lettered.mapInArrow(run, schema)
