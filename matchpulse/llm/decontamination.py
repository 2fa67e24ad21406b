"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (``window`` consecutive words, or all words of a shorter item) is a set of
word shingles. All of them must occur in a text that holds the window, so one necessary shingle, the
window's rarest in the corpus, is its prefix. Texts are joined with windows on prefix shingles
only; a pair must pass the length and position bounds, then the window's words are compared
with the text's words at that place.

Before anything is shuffled, tasks drop shingles that no item has, by a bit map of fixed size
(``common.MAP_BITS``). A full map only lets more rows through. Counts are combined before the shuffle, and
the joins end in an exchange by another key, so Spark may split a hot shingle.

Null texts have no words. Rows are separate documents even if their ids are equal or null. Items
of equal text count each; an item without an id hits words but is not listed. Empty tables give
no hits. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchpulse.llm import common as C
from matchpulse.sources.staging import staged

SHINGLE = 5

ITEM_WINDOWS = "item string, words string, n int, keys array<bigint>"
OCCURRENCES = (
    "row bigint, doc_id {doc_id}, n_words bigint, "
    "found array<struct<key: bigint, place: int, first: int, context: string>>"
)
FOUND = pa.list_(
    pa.struct([("key", pa.int64()), ("place", pa.int32()), ("first", pa.int32()), ("context", pa.string())])
)


@dataclass
class Decontamination:
    """documents: row, doc_id, n_words. spans: row, start, n (words). items: row, item (as text)."""

    documents: DataFrame
    spans: DataFrame
    items: DataFrame


class WordTable:
    """The words of the texts of an Arrow column: place in the lower-cased bytes, text, hash."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = C.flat(column)
        self.data = C.LOWER[data]
        self.starts, self.ends = C.words(self.data, C.ALNUM)
        self.hashes = C.word_hashes(self.data, self.starts, self.ends)
        self.bytes = self.data.tobytes()
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles of k words that lie in one text, and their hashes."""
        if len(self.starts) < k:
            return np.zeros(0, np.int64), np.zeros(0, C.U)
        last = np.repeat(self.bounds[1:], self.counts)
        places = np.flatnonzero(np.arange(len(self.starts)) + k <= last)
        key = np.full(len(places), C.U(k), C.U)
        for i in range(k):
            key = key * C.BASE + self.hashes[places + i]
        return places, C.mixed(key)

    def join(self, first: int, last: int) -> str:
        return b" ".join(
            self.bytes[a:b] for a, b in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist())
        ).decode("utf-8", "replace")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """A row for each window of each item: its words and the keys of its shingles in order."""

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole, "text"):
                table = WordTable(batch.column("text"))
                ids = batch.column("item").to_pylist()
                sizes = np.minimum(SHINGLE, np.minimum(table.counts, window))
                keys = {}
                for k in set(sizes.tolist()) - {0}:
                    places, hashes = table.shingles(k)
                    keys[k] = dict(zip(places.tolist(), hashes.view(np.int64).tolist()))
                out = []
                for item, begin, count, k in zip(ids, table.bounds.tolist(), table.counts.tolist(), sizes.tolist()):
                    n = min(window, count)
                    for i in range(begin, begin + count - n + 1 if n else begin):
                        out.append((item, table.join(i, i + n), n, [keys[k][j] for j in range(i, i + n - k + 1)]))
                    if len(out) >= 10_000:
                        yield _window_batch(out)
                        out = []
                if out:
                    yield _window_batch(out)

    columns = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return columns.mapInArrow(run, ITEM_WINDOWS)


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    item, text, n, keys = zip(*rows)
    kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
    return pa.record_batch(
        [pa.array(x, kind) for x, kind in zip((item, text, n, keys), kinds)], ["item", "words", "n", "keys"]
    )


def occurrences(documents: DataFrame, sizes: list[int], bits: bytes, window: int) -> DataFrame:
    """For each document the places of shingles that may be an item's, with the words around them."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        flags = np.frombuffer(shared.value, np.uint8)
        for whole in batches:
            for batch in C.slices(whole, "text"):
                table = WordTable(batch.column("text"))
                owners = np.repeat(np.arange(batch.num_rows), table.counts)
                found = []
                for k in sizes:
                    places, keys = table.shingles(k)
                    hit = np.flatnonzero(C.in_bit_map(flags, keys))
                    around = window - k if k == SHINGLE else 0
                    for place, key in zip(places[hit].tolist(), keys[hit].view(np.int64).tolist()):
                        owner = int(owners[place])
                        begin = int(table.bounds[owner])
                        a = max(begin, place - around)
                        b = min(int(table.bounds[owner + 1]), place + k + around)
                        found.append((owner, key, place - begin, a - begin, table.join(a, b)))
                found.sort()
                columns = list(zip(*found)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
                entries = pa.StructArray.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(columns[1:], kinds)], ["key", "place", "first", "context"]
                )
                per_text = np.bincount(np.array(columns[0], np.int64), minlength=batch.num_rows)
                yield pa.record_batch(
                    [batch.column("row"), batch.column("doc_id"), pa.array(table.counts, pa.int64()), C.lists(entries, per_text).cast(FOUND)],
                    ["row", "doc_id", "n_words", "found"],
                )

    schema = OCCURRENCES.format(doc_id=documents.schema["doc_id"].dataType.simpleString())
    return documents.select("row", "doc_id", "text").mapInArrow(run, schema)


def benchmark_spans(documents: DataFrame, items: DataFrame, window: int = 10) -> Decontamination:
    """Where documents hold windows of items: spans in words, and the items. Needs row, doc_id, text."""
    windows = staged(item_windows(items, window), "item-windows")
    sizes = [r[0] for r in windows.select(F.least(F.lit(SHINGLE), "n").alias("k")).distinct().collect()]
    bits = C.bit_map(windows.select(F.explode("keys").alias("key")))
    seen = staged(occurrences(documents, sorted(sizes), bits, window), "shingle-places")

    places = seen.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    counts = places.groupBy("key").agg(F.count("*").alias("times"))
    texts = windows.groupBy("words").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    prefixes = (
        texts.select("words", "n", F.posexplode("keys").alias("offset", "key"))
        .join(counts, "key", "left")
        .groupBy("words", "n")
        .agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "key", "offset")).alias("p"))
        .where("p.times > 0")
        .select("words", "n", "p.key", "p.offset")
    )
    start = F.col("place") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("context", " "), F.greatest(start - F.col("first") + 1, F.lit(1)), F.col("n")), " ") == F.col("words")
    hits = staged(
        places.join(prefixes, "key")
        .where(inside & (start >= F.col("first")))
        .where(same)
        .select("row", start.alias("start"), "n", "words")
        .distinct(),
        "item-hits",
    )
    listed = windows.where("item IS NOT NULL").select("words", "item").distinct()
    found = hits.select("row", "words").distinct().join(listed, "words").select("row", "item").distinct()
    return Decontamination(seen.select("row", "doc_id", "n_words"), hits.select("row", "start", "n").distinct(), found)


def contamination(documents: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document row: n_words, n_hit, n_items, items_sha256, contaminated."""
    parts = benchmark_spans(documents, items, window)
    before = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    hit = parts.spans.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))
    items_of = parts.items.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("ids"))
    return (
        parts.documents.join(hit, "row", "left")
        .join(items_of, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            "row",
        )
    )


def clean_documents(documents: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows whose text holds no window of an item; all columns go through.

    Contaminated texts are known again by two 64-bit hashes of different seeds and their length, so the numbers of rows
    need not be steady and no clean text goes because it shares one hash.
    """
    own = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.octet_length("text")]
    names = ["hash", "second_hash", "size"]
    digest = F.struct(*[x.alias(name) for x, name in zip(own, names)])
    found = benchmark_spans(C.numbered(documents.select(digest.alias("doc_id"), "text")), items, window)
    marks = found.documents.join(found.spans.select("row").distinct(), "row").select("doc_id.*")
    marked = staged(marks.distinct(), "contaminated-texts").select(F.struct(*names).alias("marked"))
    return documents.join(marked, reduce(and_, [x == F.col("marked")[name] for x, name in zip(own, names)]), "left_anti")
