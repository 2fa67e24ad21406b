"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every text are made once and written; trees are fitted on at most ``SAMPLE_ROWS``
labelled rows (the smallest hashes of id and statistics, a documented bound) with features cut into at
most ``BINS`` bins. All trees lie in flat arrays: a batch of documents goes down one level of
all trees per numpy step.

Null and empty texts have zero statistics and get a score like any other. Ids, languages and
sources are no features. Of several labels of an id the smallest counts; labels of unknown or null ids
are not used. Without both classes among the labels the score is the share of label 1
(0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchpulse.llm import text_stats
from matchpulse.llm.common import remainder, slices
from matchpulse.sources.staging import staged

SAMPLE_ROWS = 20_000
SAFE_SHARE = 0.95
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAST_WEIGHT = 4.0
SMOOTHING = 1.0
HELD_OUT = 5
KEPT_SCORE = 0.3
SAMPLE_ORDER = ["doc_id", *text_stats.COUNTS]


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """A row of features for each document, from its counts."""
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    chars, words, lines = (np.maximum(c[k], 1) for k in ("n_chars", "n_words", "n_lines"))
    return np.column_stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            np.log1p(c["longest_word"]),
            words / lines,
            c["n_distinct_words"] / words,
            c["n_twin_words"] / words,
            c["n_repeat_words"] / words,
            c["n_dup_lines"] / lines,
            *(c[k] / chars for k in ("n_symbols", "n_upper", "n_digits", "n_marks", "n_stops", "n_beyond")),
        ]
    )


@dataclass
class Trees:
    """All trees in flat arrays; a node's children are ``left`` and ``left + 1``, a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    above: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            inner = self.left[node] != node
            right = x[rows, self.feature[node]] > self.above[node]
            node = self.left[node] + (right & inner)
        return self.base + self.value[node].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _best_split(bins, rows, gradient, hessian, n_bins):
    """The split of a node of the highest gain: (gain, feature, bin), rows with a bin up to it go left."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, 0, 0)
    for f in range(bins.shape[1]):
        own = bins[rows, f]
        gl = np.cumsum(np.bincount(own, gradient[rows], n_bins))[:-1]
        hl = np.cumsum(np.bincount(own, hessian[rows], n_bins))[:-1]
        gain = gl**2 / (hl + SMOOTHING) + (g - gl) ** 2 / (h - hl + SMOOTHING) - g**2 / (h + SMOOTHING)
        gain[(hl < LEAST_WEIGHT) | (h - hl < LEAST_WEIGHT)] = 0
        at = int(np.argmax(gain))
        best = max(best, (float(gain[at]), f, at))
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for the probability of label 1."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        one = np.zeros(1, np.int64)
        return Trees(one, one, np.zeros(1), one, np.zeros(1), base, 0)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    bins = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)])
    feature, above, left, value, roots = [], [], [], [], []

    def leaf() -> int:
        feature.append(0)
        above.append(0.0)
        left.append(len(left))
        value.append(0.0)
        return len(left) - 1

    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        roots.append(leaf())
        todo = [(roots[-1], np.arange(len(y)), 0)]
        while todo:
            node, rows, level = todo.pop()
            gain, f, at = _best_split(bins, rows, gradient, hessian, BINS) if level < depth else (0, 0, 0)
            if gain > 1e-6:
                feature[node], above[node] = f, float(cuts[f][at])
                left[node] = leaf()
                leaf()
                right = bins[rows, f] > at
                todo += [(left[node], rows[~right], level + 1), (left[node] + 1, rows[right], level + 1)]
            else:
                value[node] = RATE * float(gradient[rows].sum() / (hessian[rows].sum() + SMOOTHING))
                margin[rows] += value[node]
    whole, real = (lambda v: np.array(v, np.int64)), (lambda v: np.array(v, np.float64))
    return Trees(whole(roots), whole(feature), real(above), whole(left), real(value), base, depth)


def labelled_sample(statistics: DataFrame, labels: DataFrame, train: Column, bound: int) -> DataFrame:
    """Statistics and label of at most ``bound`` labelled rows: those of the smallest hashes of id and statistics.

    The hash below which rows are taken comes from their number, so that the sample is small before
    it leaves the tasks. Row numbers have no part in it, so it is the same however the table is split.
    """
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = staged(statistics.where(train).join(own, "doc_id"), "labelled")
    share = min(1.0, SAFE_SHARE * bound / max(1, rows.count()))
    place = F.pmod(F.xxhash64(*SAMPLE_ORDER), F.lit(1 << 32)) / float(1 << 32)
    return rows.where(place < share).orderBy(place, *SAMPLE_ORDER).limit(bound) if share < 1 else rows


def fit_quality(statistics: DataFrame, labels: DataFrame, train: Column, bound: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on a bounded sample of the labelled rows for which ``train`` holds."""
    sample = labelled_sample(statistics, labels, train, bound).toPandas().sort_values(SAMPLE_ORDER)
    return fit(features({k: sample[k] for k in text_stats.COUNTS}), (sample["quality"].to_numpy() == 1).astype(np.float64))


def scored(statistics: DataFrame, trees: Trees) -> DataFrame:
    """row, doc_id, score of every row of the statistics."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x = features({k: part.column(k).to_numpy() for k in text_stats.COUNTS})
                score = pa.array(trees.scores(x), pa.float64())
                yield pa.record_batch([part.column("row"), part.column("doc_id"), score], ["row", "doc_id", "score"])

    return statistics.mapInArrow(run, "row bigint, doc_id bigint, score double")


def _held_out() -> Column:
    return F.coalesce(remainder("doc_id", HELD_OUT) == 0, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """row, doc_id, held_out, score, predicted. ``documents`` needs row, doc_id, text."""
    statistics = staged(text_stats.document_statistics(documents), "quality-statistics")
    trees = fit_quality(statistics, labels, ~_held_out())
    return scored(statistics, trees).select(
        "row", "doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= KEPT_SCORE).cast("int").alias("predicted")
    )


def fit_documents(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on a bounded sample of labelled documents (row, doc_id, text) that are not held out.

    Only documents of the labelled ids with the smallest hashes are described: a few more than ``bound``, so their ids are
    few enough to broadcast whatever the input, and no text is shuffled.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id")
    learned = documents.where(~_held_out())
    ids = staged(learned.select("doc_id").join(known, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("rows")), "labelled-ids")
    share = min(1.0, SAFE_SHARE * bound / max(1, ids.agg(F.sum("rows")).first()[0] or 0))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32) < share
    few = learned.where(chosen).join(F.broadcast(ids.where(chosen).select("doc_id")), "doc_id", "left_semi")
    statistics = staged(text_stats.document_statistics(few), "quality-sample")
    return fit_quality(statistics, labels, F.lit(True), bound)


def accepted(documents: DataFrame, trees: Trees) -> DataFrame:
    """The rows whose text gets a score of at least KEPT_SCORE; all columns go through."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                kept = trees.scores(features(text_stats.statistics(batch.column("text")))) >= KEPT_SCORE
                yield batch.filter(pa.array(kept))

    return documents.mapInArrow(run, documents.schema)
