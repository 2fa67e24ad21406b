"""Ranked lexical search by pipelined term partitioning.

*Postings.* A pass over the texts counts each document's terms; only terms that a bit map of fixed size holds
leave it, and joining the terms of the items drops what the map let through by chance. Documents lie in
shards of ``SHARD`` rows.

*Owners.* Every term has one of ``OWNERS`` owners by the share of documents that hold it, the rarest terms first.
For each shard an item has a bundle: its terms and an accumulator for each document that may still be among
the best. Bundles go through the owners one after the other; in each a cogroup by (shard, part of the items) brings
them to the owner's postings, and contributions are added as whole numbers.

*Bounds.* Between owners an accumulator goes only if its score with the most that its later terms can add lies below
the score that ``best`` documents of the item already have, in the shard or anywhere. Equal scores stay.
So the result is whole, and no bundle holds more than a shard's documents.

*Selection.* The last owner hands on the ``best`` of each bundle; they are ranked per item over all shards.

A null text has no terms; items without terms and documents without a term of the item are not in the result. Each
row of the items is an item of its own, repeated ids included. Of equal scores the smaller doc_id comes first, rows
without id last, then the row number. Empty tables give an empty result. Other columns are left aside.
The id 2^63 - 1 is read as none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchpulse.llm import common as C
from matchpulse.sources.staging import staged

BEST = 10
OWNERS = 4
SHARD_BITS = 12
SHARD = 1 << SHARD_BITS
#: Items that go through the owners together.
PART = 500
#: A longer text is counted in stretches.
LONG_TEXT = 8_000_000
MAP_BITS = 24
NO_ID = np.iinfo(np.int64).max
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MILLIARD = 1_000_000_000

POSTINGS = "row bigint, doc_id bigint, n bigint, terms array<string>, counts array<int>"
BUNDLE = (
    "shard bigint, part int, item bigint, numbers array<bigint>, weights array<bigint>, owners array<int>, mosts array<bigint>, "
    "rows array<int>, doc_ids array<bigint>, sizes array<bigint>, scores array<bigint>, best array<bigint>"
)


def _stretches(data: np.ndarray):
    """Parts of the bytes of a long text; no term is cut."""
    start = 0
    while start < len(data):
        end = min(start + LONG_TEXT, len(data))
        while end < len(data) and C.ALNUM[data[end]]:
            ahead = np.flatnonzero(~C.ALNUM[data[end : end + LONG_TEXT]])
            end = end + int(ahead[0]) if len(ahead) else min(end + LONG_TEXT, len(data))
        yield start, end
        start = end


def _counted(data: np.ndarray, offsets: np.ndarray, bits: np.ndarray | None):
    """Terms per text: numbers of all, and of those in the bit map text, hash, count, first start and end."""
    starts, ends = C.words(data, C.ALNUM)
    text = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(text, minlength=len(offsets) - 1)
    hashes = C.word_hashes(data, starts, ends)
    if bits is not None:
        held = C.in_bit_map(bits, hashes)
        starts, ends, text, hashes = starts[held], ends[held], text[held], hashes[held]
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])][: len(text)])
    counts = np.diff(np.r_[new, len(text)])
    return n, text[new], hashes[new], counts, starts[order][new], ends[order][new]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    taken = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(taken.astype(np.uint8)))


def _long(data: np.ndarray, bits: np.ndarray | None):
    """What ``_counted`` and ``_strings`` give for one long text, counted in stretches."""
    n, found = 0, {}
    for start, end in _stretches(data):
        part = data[start:end]
        own, _, hashes, counts, starts, ends = _counted(part, np.array([0, len(part)]), bits)
        n += int(own.sum())
        for h, count, a, b in zip(hashes.tolist(), counts.tolist(), starts.tolist(), ends.tolist()):
            held = found.get(h)
            found[h] = (held[0] + count, held[1]) if held else (count, part[a:b].tobytes().decode())
    return n, [x for _, x in found.values()], [x for x, _ in found.values()]


def postings(table: DataFrame, bits: bytes | None) -> DataFrame:
    """row, doc_id, n (all terms), and the terms whose bits are set with their counts, of every text."""
    shared = table.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        own = None if shared.value is None else np.frombuffer(shared.value, np.uint8)
        for whole in batches:
            for batch in C.slices(whole, "text"):
                data, offsets = C.flat(batch.column("text"))
                data = C.LOWER[data]
                if batch.num_rows == 1 and len(data) > LONG_TEXT:
                    n, terms, counts = _long(data, own)
                    columns = [pa.array([x], t) for x, t in ((n, pa.int64()), (terms, pa.list_(pa.string())), (counts, pa.list_(pa.int32())))]
                else:
                    n, text, _, counts, starts, ends = _counted(data, offsets, own)
                    held = np.bincount(text, minlength=batch.num_rows)
                    counts = pa.array(counts.astype(np.int32))
                    columns = [pa.array(n, pa.int64()), C.lists(_strings(data, starts, ends), held), C.lists(counts, held)]
                yield pa.record_batch([batch.column("row"), batch.column("doc_id"), *columns], ["row", "doc_id", "n", "terms", "counts"])

    return table.select("row", "doc_id", "text").mapInArrow(run, POSTINGS)


def _term_keys(terms: DataFrame) -> DataFrame:
    """The hashes (key) of single terms (term)."""

    def run(batches):
        for batch in batches:
            data, offsets = C.flat(batch.column("term"))
            yield pa.record_batch([pa.array(C.word_hashes(data, offsets[:-1], offsets[1:] - 1).view(np.int64))], ["key"])

    return terms.select("term").mapInArrow(run, "key bigint")


def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, part, term: each item's terms once; ``items`` has item (its number), item_id and text."""
    lowered = F.translate("text", UPPER, UPPER.lower())
    part = F.floor(F.col("place") / PART).cast("int").alias("part")
    term = F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))))
    # items of one partition are numbered in a row, so parts are runs of them
    place = F.col("item").bitwiseAND((1 << 33) - 1)
    return items.withColumn("place", place).select("item", "item_id", part, term.alias("term"))


def _weighted(found: DataFrame, wanted: DataFrame, documents: int) -> DataFrame:
    """Terms of items that occur, numbered, with weight, owner and the most occurrences in a document."""
    seen = found.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("x.terms", "x.counts")
    known = seen.groupBy(F.col("terms").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.max("counts").cast("bigint").alias("most"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    df = F.col("df")
    owner = F.when(df * 1000 <= documents, 0).when(df * 100 <= documents, 1).when(df * 10 <= documents, 2).otherwise(OWNERS - 1)
    own = known.join(wanted.select("term").distinct(), "term").select("term", weight.alias("weight"), owner.alias("owner"), "most")
    return C.numbered(own, "number")


def _flat(found: DataFrame, terms: DataFrame, wanted: DataFrame, documents: int, total: int) -> DataFrame:
    """One row per document, term and part of the items that asks for it: what one occurrence set adds before weighting."""
    size = (F.lit(10) + F.floor(F.expr(f"(90L * n * {documents}L) div {max(total, 1)}L"))).cast("bigint")
    asked = wanted.select("term", "part").distinct().join(terms.select("term", "number", "owner"), "term")
    seen = found.select("row", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), size.alias("size"), F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    gain = F.expr(f"({MILLIARD}L * tf) div (1000L * tf + 8L * size)")
    return (
        seen.select("row", "doc_id", "size", F.col("x.terms").alias("term"), F.col("x.counts").cast("bigint").alias("tf"))
        .join(asked, "term")
        .select(F.shiftright("row", SHARD_BITS).alias("shard"), "part", "owner", "number", "row", "doc_id", "size", gain.alias("gain"))
    )


def _bundles(flat: DataFrame, terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """A bundle without accumulators for each shard and item that share a term."""
    there = flat.select("shard", "part", "number").distinct()
    asked = wanted.select("item", "part", "term").join(terms, "term").drop("term")
    own = there.join(asked, ["part", "number"]).groupBy("shard", "part", "item")
    listed = own.agg(F.sort_array(F.collect_list(F.struct("number", "weight", "owner", "most"))).alias("t"))
    empty = [F.array().cast(f"array<{t}>").alias(n) for n, t in (("rows", "int"), ("doc_ids", "bigint"), ("sizes", "bigint"), ("scores", "bigint"), ("best", "bigint"))]
    names = {"numbers": "number", "weights": "weight", "owners": "owner", "mosts": "most"}
    return listed.select("shard", "part", "item", *[F.col(f"t.{v}").alias(k) for k, v in names.items()], *empty)


def _lists_of(table: pa.Table, name: str) -> list[np.ndarray]:
    column = table.column(name).combine_chunks()
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0] if len(offsets) else offsets
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


class Shard:
    """An owner's postings of one shard, by term."""

    def __init__(self, table: pa.Table) -> None:
        number = table.column("number").to_numpy()
        order = np.argsort(number, kind="stable")
        self.numbers, begin = np.unique(number[order], return_index=True)
        self.edges = np.r_[begin, len(order)]
        self.place = (table.column("row").to_numpy()[order] & (SHARD - 1)).astype(np.int32)
        self.gain = table.column("gain").to_numpy()[order]
        self.doc_ids, self.sizes = np.zeros(SHARD, np.int64), np.ones(SHARD, np.int64)
        self.doc_ids[self.place] = table.column("doc_id").to_numpy()[order]
        self.sizes[self.place] = table.column("size").to_numpy()[order]

    def add(self, scores: np.ndarray, numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Add the contributions of terms to the scores; which documents got some."""
        touched = np.zeros(SHARD, bool)
        at = np.searchsorted(self.numbers, numbers)
        for i, number, weight in zip(at.tolist(), numbers.tolist(), weights.tolist()):
            if i < len(self.numbers) and self.numbers[i] == number:
                own = slice(self.edges[i], self.edges[i + 1])
                place = self.place[own]
                scores[place] += weight * self.gain[own]
                touched[place] = True
        return touched


def _most(weights: np.ndarray, mosts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The most that terms can add to documents of given sizes."""
    out = np.zeros(len(sizes), np.int64)
    for weight, most in zip(weights.tolist(), mosts.tolist()):
        out += weight * ((MILLIARD * most) // (1000 * most + 8 * sizes))
    return out


def _greatest(scores: np.ndarray, best: int) -> np.ndarray:
    return scores if len(scores) <= best else np.partition(scores, len(scores) - best)[len(scores) - best :]


def _advance(bundles: DataFrame, postings: DataFrame, owner: int, best: int) -> DataFrame:
    """Bundles with the contributions of one owner's terms; hopeless accumulators are dropped."""
    last = owner == OWNERS - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(right)
        lists = {n: _lists_of(left, n) for n in ("numbers", "weights", "owners", "mosts", "rows", "doc_ids", "sizes", "scores")}
        floors = left.column("floor").to_numpy(zero_copy_only=False)
        out = {n: [] for n in ("rows", "doc_ids", "sizes", "scores", "best")}
        for i, floor in enumerate(floors.tolist()):
            numbers, weights, owners, mosts = (lists[n][i] for n in ("numbers", "weights", "owners", "mosts"))
            held = lists["rows"][i]
            scores = np.zeros(SHARD, np.int64)
            scores[held] = lists["scores"][i]
            shard.doc_ids[held], shard.sizes[held] = lists["doc_ids"][i], lists["sizes"][i]
            touched = shard.add(scores, numbers[owners == owner], weights[owners == owner])
            touched[held] = True
            rows = np.flatnonzero(touched)
            own, sizes = scores[rows], shard.sizes[rows]
            top = _greatest(own, best)
            if len(top) == best:
                floor = max(floor, int(top.min()))
            later = owners > owner
            if later.any() and len(rows):  # first with one bound for all, then with each document's own
                keep = own + _most(weights[later], mosts[later], sizes.min(keepdims=True))[0] >= floor
                rows, own, sizes = rows[keep], own[keep], sizes[keep]
                keep = own + _most(weights[later], mosts[later], sizes) >= floor
            else:
                keep = (own >= floor) & (own > 0)
            rows, own = rows[keep], own[keep]
            if last and len(rows) > best:
                order = np.lexsort((rows, shard.doc_ids[rows], -own))[:best]
                rows, own = rows[order], own[order]
            for name, values in (("rows", rows), ("doc_ids", shard.doc_ids[rows]), ("sizes", shard.sizes[rows]), ("scores", own), ("best", top)):
                out[name].append(values)
        columns = {n: left.column(n) for n in ("shard", "part", "item", "numbers", "weights", "owners", "mosts")}
        for name, values in out.items():
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            kind = np.int32 if name == "rows" else np.int64
            columns[name] = C.lists(pa.array(flat.astype(kind)), np.array([len(x) for x in values], np.int64))
        return pa.table(columns)

    group = ["shard", "part"]
    return bundles.groupBy(*group).cogroup(postings.groupBy(*group)).applyInArrow(run, BUNDLE)


def _with_floors(bundles: DataFrame, best: int) -> DataFrame:
    """Bundles with the score that ``best`` documents of the item reach at least."""
    ranked = Window.partitionBy("item").orderBy(F.desc("score"))
    scores = bundles.select("item", F.explode("best").alias("score")).withColumn("place", F.row_number().over(ranked))
    floors = scores.filter(F.col("place") == best).select("item", F.col("score").alias("floor"))
    return bundles.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("bigint")))


def search(documents: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item, item_id, rank, doc_id, score: the ``best`` documents of each item with a score above 0.

    ``documents`` has row, doc_id, text; ``items`` has item (its number), item_id, text.
    """
    wanted = staged(item_terms(items), "search-items")
    bits = C.bit_map(_term_keys(wanted.select("term").distinct()), MAP_BITS)
    found = staged(postings(documents, bits), "search-postings")
    size = found.filter("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    terms = staged(_weighted(found, wanted, size["documents"]), "search-terms")
    flat = staged(_flat(found, terms, wanted, size["documents"], size["terms"]), "search-flat", "owner")
    bundles = staged(_bundles(flat, terms, wanted), "search-bundles")
    for owner in range(OWNERS):
        own = flat.filter(F.col("owner") == owner).drop("owner")
        bundles = staged(_advance(_with_floors(bundles, best), own, owner, best), f"search-owner-{owner}")
    answers = bundles.select("item", F.shiftleft("shard", SHARD_BITS).alias("first"), F.explode(F.arrays_zip("rows", "doc_ids", "scores")).alias("x"))
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row")
    chosen = (
        answers.select("item", (F.col("first") + F.col("x.rows")).alias("row"), F.col("x.doc_ids").alias("doc_id"), F.col("x.scores").alias("score"))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= best)
    )
    names = wanted.select("item", "item_id").distinct()
    doc_id = F.when(F.col("doc_id") < int(NO_ID), F.col("doc_id")).alias("doc_id")
    return chosen.join(names, "item").select("item", "item_id", "rank", doc_id, "score")
