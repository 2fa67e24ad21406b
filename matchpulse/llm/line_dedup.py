"""Line dedup by a sharded minimal perfect hash over the distinct line hashes.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Long keys found in
many documents lose their lines everywhere but in the largest doc_id that holds them.

Tasks gather the key hashes (128 bits) of a block of documents, count them, and send them to shards
as packed arrays, one per block and shard, so a line that a third of all documents share costs
one entry per block. A shard numbers its distinct hashes by a minimal perfect hash; arrays of
fingerprints, counts (up to 255) and largest ids stand under those numbers. The packed arrays of
each block then probe them, and only the frequent hits go back to the block's documents. Lines
themselves are neither shuffled nor joined.

A document is a row; null and empty texts have one empty line. A null doc_id counts as a document
and is never the largest; a key found under null ids only keeps its lines. Rows that share the
largest doc_id all keep theirs. Empty tables stay empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchpulse.llm.common import U
from matchpulse.llm.minimal_hash import MinimalHash
from matchpulse.sources.staging import staged

SPACE = " \t\n\x0b\x0c\r"
NO_ID = np.iinfo(np.int64).min
BLOCK_BITS = 11
#: Bytes of text whose lines meet in one shard, and bytes of text that a task gets back with the hits.
SHARD_BYTES = 64_000_000
TASK_BYTES = 32_000_000
MIN_SHARDS = 32


def _key(line: str, least: int) -> bytes | None:
    """Hash of the line's key, or None if the key is too short to count."""
    line = line.strip(SPACE)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= least else None


def _packed_counts(digests: list[bytes], ids: list[int], shards: int, block: int):
    """The distinct digests of a block by shard: packed digests, documents that hold each, largest id."""
    pairs = np.frombuffer(b"".join(digests), U).reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0], pairs[:, 0] % U(shards)))
    pairs, ids = pairs[order], np.array(ids, np.int64)[order]
    first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)])
    counts = np.diff(np.r_[first, len(pairs)]).astype(np.int64)
    last = np.maximum.reduceat(ids, first)
    pairs = pairs[first]
    shard = (pairs[:, 0] % U(shards)).astype(np.int32)
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(shard[a]), block, pairs[a:b].tobytes(), counts[a:b].tobytes(), last[a:b].tobytes()


def packed_lines(documents: DataFrame, least: int, shards: int) -> DataFrame:
    """Packed line hashes of each block of documents, one row per block and shard."""
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ["shard", "block", "digests", "counts", "last"]

    def batch_of(block, digests, ids):
        columns = zip(*_packed_counts(digests, ids, shards, block))
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, kinds)], names)

    def run(batches):
        block, digests, ids = None, [], []
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if row >> BLOCK_BITS != block or len(digests) > 1_000_000:
                    if digests:
                        yield batch_of(block, digests, ids)
                    block, digests, ids = row >> BLOCK_BITS, [], []
                own = {_key(line, least) for line in (text or "").split("\n")}
                own.discard(None)
                digests += own
                ids += [NO_ID if doc_id is None else doc_id] * len(own)
        if digests:
            yield batch_of(block, digests, ids)

    schema = "shard int, block bigint, digests binary, counts binary, last binary"
    return documents.select("row", "doc_id", "text").mapInArrow(run, schema)


class LineTable:
    """Fingerprints, counts and largest ids of a shard's distinct hashes, under perfect hash numbers."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs, counts, last = pairs[order], counts[order], last[order]
        first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)])
        counts, last = np.add.reduceat(counts, first), np.maximum.reduceat(last, first)
        pairs = pairs[first]
        self.hash = MinimalHash(pairs[:, 0], pairs[:, 1])
        number = self.hash.number(pairs[:, 0], pairs[:, 1])
        self.fingerprints, self.counts = np.empty(len(pairs), np.uint32), np.empty(len(pairs), np.uint8)
        self.last = np.empty(len(pairs), np.int64)
        self.fingerprints[number] = (pairs[:, 1] >> U(32)).astype(np.uint32)
        self.counts[number] = np.minimum(counts, 255)
        self.last[number] = last

    def probe(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold each hash (up to 255; 0: none) and the largest id among them."""
        number = self.hash.number(pairs[:, 0], pairs[:, 1])
        known = (number >= 0) & (self.fingerprints[number] == (pairs[:, 1] >> U(32)).astype(np.uint32))
        return np.where(known, self.counts[number], 0), np.where(known, self.last[number], NO_ID)


def frequent_lines(packed: DataFrame, least_documents: int) -> DataFrame:
    """For each block its hashes found in enough documents, with the largest id holding each."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(x, U).reshape(-1, 2) for x in frame["digests"]]
        numbers = [np.concatenate([np.frombuffer(x, np.int64) for x in frame[c]]) for c in ("counts", "last")]
        table = LineTable(np.concatenate(arrays), *numbers)
        out = []
        for block, pairs in zip(frame["block"], arrays):
            counts, last = table.probe(pairs)
            hit = (counts >= least_documents) & (last != NO_ID)
            if hit.any():
                out.append((block, pairs[hit].tobytes(), last[hit].tobytes()))
        return pd.DataFrame(out, columns=["block", "digests", "last"])

    return packed.groupBy("shard").applyInPandas(run, "block bigint, digests binary, last binary")


def deduplicated_lines(table: DataFrame, least: int = 40, least_documents: int = 5) -> DataFrame:
    """row, doc_id, n_lines, n_dropped, text (kept lines; null stays null), rest.

    ``table`` has row, doc_id, text and a struct ``rest`` that goes through, and must be a written table:
    it is read twice, and its row numbers must be the same both times.
    """
    if least_documents > 255:
        raise ValueError("counts are kept up to 255")
    size = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(MIN_SHARDS, -(-size // SHARD_BYTES))
    hits = staged(frequent_lines(packed_lines(table, least, shards), least_documents), "lines-frequent")

    block = F.shiftright("row", BLOCK_BITS).alias("block")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in hits.dtypes if name != "block"]
    own = [F.lit(None).cast(table.schema[name].dataType).alias(name) for name in ("row", "doc_id", "text", "rest")]
    both = table.select(block, F.lit(1).alias("kind"), "row", "doc_id", "text", "rest", *none).unionByName(
        hits.select("block", F.lit(0).alias("kind"), *own, "digests", "last")
    )
    kept = table.select("row", "doc_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "text", "rest")

    def run(batches):
        block, last_of = None, {}
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            picked, numbers, dropped, texts = [], [], [], []
            lists = (column[name].to_pylist() for name in ("block", "kind", "doc_id", "text", "digests", "last"))
            for i, (at, kind, doc_id, text, digests, last) in enumerate(zip(*lists)):
                if at != block:
                    block, last_of = at, {}
                if kind == 0:
                    last_of |= zip((digests[j : j + 16] for j in range(0, len(digests), 16)), np.frombuffer(last, np.int64).tolist())
                    continue
                lines = (text or "").split("\n")
                stay = lines
                if last_of:
                    stay = [x for x in lines if (k := _key(x, least)) is None or last_of.get(k, doc_id) == doc_id]
                picked.append(i)
                numbers.append(len(lines))
                dropped.append(len(lines) - len(stay))
                texts.append(text if len(stay) == len(lines) else "\n".join(stay))
            if picked:
                rows = pa.array(picked, pa.int64())
                yield pa.record_batch(
                    [
                        column["row"].take(rows),
                        column["doc_id"].take(rows),
                        pa.array(numbers, pa.int64()),
                        pa.array(dropped, pa.int64()),
                        pa.array(texts, pa.string()),
                        column["rest"].take(rows),
                    ],
                    ["row", "doc_id", "n_lines", "n_dropped", "text", "rest"],
                )

    spark = table.sparkSession
    least_tasks = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.repartition(max(least_tasks, -(-size // TASK_BYTES)), "block")
    return dealt.sortWithinPartitions("block", "kind").mapInArrow(run, kept.schema)
