"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints link at ``distance`` or fewer differing bits. Each of the 64 bits gets a vector of
distance + 1 bits; for each non-zero vector v a mask holds the bits whose vectors have an odd
product with v. Any ``distance`` differing bits satisfy an equation too few to leave no v, so some
mask holds none of them: every pair within the distance meets in some table, with certainty.

Documents of equal fingerprints are one class from the start, so only distinct fingerprints go into
the tables. A bucket is compared in one task by blocks, and gives a spanning set of links, never
all pairs. Buckets over ``BUCKET`` fingerprints are dealt again by that mask together with a second
one from another choice of vectors, for which the same certainty holds; the bits left free then
bound a bucket. Links become components by rounds of hooking and shortcutting over written tables.

A document is a row. Null and empty texts have no words: fingerprint zero, linked as any other.
Null ids count for nothing in the smallest id. Empty tables stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchpulse.llm.common import U
from matchpulse.sources.staging import staged

SEED = 42
BUCKET = 2_000
#: Steps in which consecutive bits run through the vectors, one for each level of buckets.
STEPS = (1, 12)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text, as a signed number."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(found) - shingle + 1)
    pieces = zip(starts[:n].tolist(), ends[min(shingle, len(found)) - 1 :].tolist())
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    stack = []
    for a, b in pieces:
        stack.append(digest(joined[a:b], SEED))
        if len(stack) == 100_000:
            ones += _ones(stack)
            stack = []
    if stack:
        ones += _ones(stack)
    bits = np.packbits(2 * ones > n)
    return int(bits.view(">i8")[0])


def _ones(digests: list[bytes]) -> np.ndarray:
    """How many digests (big-endian) have each bit set."""
    rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """The rows with bits (the fingerprint as a signed number) in place of text."""
    others = [c for c in documents.columns if c != "text"]

    def run(batches):
        for batch in batches:
            bits = [fingerprint(text.as_py(), shingle) for text in batch.column("text")]
            yield pa.record_batch([*(batch.column(c) for c in others), pa.array(bits, pa.int64())], [*others, "bits"])

    schema = documents.select(*others, F.lit(0).cast("long").alias("bits")).schema
    return documents.select(*others, "text").mapInArrow(run, schema)


def covering_masks(distance: int, step: int) -> list[int]:
    """Masks of 64 bits such that any ``distance`` bits lie outside at least one of them."""
    vectors = (1 << distance + 1) - 1
    of_bit = [1 + i * step % vectors for i in range(64)]
    return [sum(1 << i for i, x in enumerate(of_bit) if (x & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucket_links(keyed: DataFrame, distance: int, last: bool) -> DataFrame:
    """Links inside each bucket (rows sorted by bucket): bits, other, refine.

    Rows of a bucket over BUCKET come back as they are, with refine set, unless it is the last level.
    """

    def linked(values: list[int]):
        found = np.array(values, np.int64)
        bits = found.view(U)
        left = np.ones(len(bits), bool)
        for i in range(len(bits)):  # grow each component from its first member: one link per member
            if not left[i]:
                continue
            left[i] = False
            heap = [i]
            while heap:
                at = heap.pop()
                rest = np.flatnonzero(left)
                near = rest[np.bitwise_count(bits[rest] ^ bits[at]) <= distance]
                left[near] = False
                heap += near.tolist()
                for j in near.tolist():
                    yield values[at], values[j], False

    def run(batches):
        bucket, values, large, out = None, [], False, []

        def close():
            if not large and len(values) > 1:
                out.extend(linked(values))

        for batch in batches:
            table = batch.column("mask").to_numpy(zero_copy_only=False)
            key = batch.column("key").to_numpy(zero_copy_only=False)
            bits = batch.column("bits").to_pylist()
            begins = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[begins[1:], len(bits)]
            several = ends - begins > 1
            several[[0, -1]] = True  # these may go on in another batch
            for a, b in zip(begins[several].tolist(), ends[several].tolist()):
                if (table[a], key[a]) != bucket:
                    close()
                    bucket, values, large = (table[a], key[a]), [], False
                values += bits[a:b]
                if large or (not last and len(values) > BUCKET):
                    large = True
                    out.extend((x, x, True) for x in values)
                    values = []
            if out:
                yield _links(out)
                out = []
        close()
        if out:
            yield _links(out)

    return keyed.mapInArrow(run, "bits bigint, other bigint, refine boolean")


def _links(rows: list[tuple]) -> pa.RecordBatch:
    bits, other, refine = zip(*rows)
    return pa.record_batch(
        [pa.array(bits, pa.int64()), pa.array(other, pa.int64()), pa.array(refine, pa.bool_())],
        ["bits", "other", "refine"],
    )


def near_links(distinct: DataFrame, distance: int) -> DataFrame:
    """Links that connect all fingerprints within the distance (bits, other)."""
    coarse, second = (covering_masks(distance, step) for step in STEPS)
    fine = sorted({a | b for a in coarse for b in second})
    rows, out = distinct.select("bits"), []
    for level, masks in enumerate((coarse, fine)):
        tables = rows.select("bits", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
        keyed = (
            tables.withColumn("key", F.col("bits").bitwiseAND(F.col("mask")))
            .repartition("mask", "key")
            .sortWithinPartitions("mask", "key")
            .select("mask", "key", "bits")
        )
        found = staged(bucket_links(keyed, distance, last=masks is fine), f"simhash-links-{level}")
        out.append(found.where("NOT refine").select("bits", "other").distinct())
        rows = found.where("refine").select("bits").distinct()
        if level == 0 and rows.isEmpty():
            return out[0]
    return out[0].unionByName(out[1])


def components(links: DataFrame) -> DataFrame:
    """bits, root: for each linked fingerprint the smallest of its component (as a signed number).

    Each round joins every node with its neighbours' smallest label and then follows that label's own
    label; labels are written tables, and only nodes with links take part.
    """
    edges = staged(
        links.unionByName(links.select(F.col("other").alias("bits"), F.col("bits").alias("other"))).distinct(),
        "component-edges",
    )
    labels = staged(edges.groupBy("bits").agg(F.least("bits", F.min("other")).alias("root")), "component-labels")
    while True:
        seen = edges.join(labels.select(F.col("bits").alias("other"), "root"), "other").groupBy("bits").agg(F.min("root").alias("near"))
        hooked = labels.join(seen, "bits").select("bits", "root", F.least("root", "near").alias("next"))
        # a root takes the smallest label that any of its members has met, members follow their root
        pulled = hooked.groupBy("root").agg(F.min("next").alias("pulled"))
        moved = hooked.join(pulled, "root").select("bits", F.col("root").alias("old"), F.least("next", "pulled").alias("root"))
        new = staged(moved, "component-labels")
        if new.where("root != old").isEmpty():
            return new.select("bits", "root")
        labels = new.select("bits", "root")


def classes_of(marked: DataFrame, distance: int) -> DataFrame:
    """bits, best: for each fingerprint the least (doc_id, place) of its component, ids before nulls.

    ``marked`` has doc_id, place (orders rows of one id) and bits, and is a written table.
    """
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("place"))
    classes = staged(marked.groupBy("bits").agg(F.min(order).alias("least")), "fingerprint-classes")
    roots = components(near_links(classes, distance))
    rooted = classes.join(roots, "bits", "left").select("bits", F.coalesce("root", "bits").alias("root"), "least")
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    return staged(
        rooted.join(best, "root").select("bits", F.struct(F.col("best.doc_id"), F.col("best.place")).alias("best")), "fingerprint-components"
    )


def near_duplicates(documents: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """row, doc_id, bits, component_id (the smallest doc_id of the component). Needs row, doc_id, text."""
    rows = documents.select("row", "doc_id", "text")
    marked = staged(fingerprints(rows, shingle).withColumn("place", F.col("row")), "fingerprints")
    classes = classes_of(marked, distance)
    return marked.join(classes, "bits").select("row", "doc_id", "bits", F.col("best.doc_id").alias("component_id"))


def first_of_each(documents: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The one row of each component that has its smallest doc_id; all columns go through.

    Rows are known by doc_id and a hash of the text; of rows equal in both any one stays.
    """
    place = F.xxhash64("text")
    marked = staged(fingerprints(documents.select("doc_id", place.alias("place"), "text"), shingle), "fingerprints")
    best = classes_of(marked, distance).select("best.doc_id", "best.place").distinct()
    copies = marked.groupBy("doc_id", "place").agg(F.count("*").alias("copies"))
    stay = best.join(copies, best["doc_id"].eqNullSafe(copies["doc_id"]) & (best["place"] == copies["place"])).select(
        copies["doc_id"], copies["place"], "copies"
    )
    known = documents.withColumn("place", place).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.place") == F.col("s.place"))
    found = known.join(staged(stay, "fingerprint-firsts").alias("s"), same).select("d.*", "copies")
    single = found.where("copies = 1").drop("place", "copies")
    several = found.where("copies > 1").dropDuplicates(["doc_id", "place"]).drop("place", "copies")
    return single.unionByName(several)
