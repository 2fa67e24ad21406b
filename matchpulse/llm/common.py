"""Helpers of the operators: numbered rows, Arrow texts as flat bytes, word tables, hashes.

Inside tasks the texts of an Arrow batch are handled as one flat byte array with a newline after
each text, so that word edges, hashes and counts come from a few numpy passes instead of a Python
loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1_000_000
BATCH_ROWS = 500
MAP_BITS = 26
MAP_PARTS = 64
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True
#: Bytes of words between ASCII white space.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """Add a number of its own to each row. Numbers are steady only once the table is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches hold ``rows`` rows unless the session asks for another number than Spark's own 10,000.

    Batches of 10,000 texts took 600 MB more beside the heap than batches of 500.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(rows))


def remainder(id_column: Column | str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; null for a null id."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(column.cast("string").cast("binary")) % divisor


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``size`` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(lengths, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by a newline, and the n + 1 offsets."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    ended = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    _, offsets, data = ended.buffers()
    offsets = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Powers:
    """Powers of the hash base and of its inverse, made once as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(n + n // 4 + 1, base, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))
        return self.up, self.down


POWERS = Powers()


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [start, end) of an integer array; equal ranges, equal hashes."""
    up, down = POWERS.upto(len(values) + 1)
    sums = np.empty(len(values) + 1, U)
    sums[0] = 0
    np.cumsum((values.astype(U) + U(1)) * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of a kind."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = kind[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, made in stretches so that one long text needs little room."""
    out, first = [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, "right")))
        a, b = starts[first], ends[last - 1]
        out.append(range_hashes(data[a:b], starts[first:last] - a, ends[first:last] - a))
        first = last
    return np.concatenate(out) if out else np.zeros(0, U)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list array of consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def bit_map(keys: DataFrame, bits: int = MAP_BITS) -> bytes:
    """A bit map of the top bits of all 64-bit keys (column key): 2**bits bits whatever the number of keys, made in MAP_PARTS parts."""
    part_bits = (1 << bits) // MAP_PARTS

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            place = (batch.column(0).to_numpy(zero_copy_only=False).view(U) >> U(64 - bits)).astype(np.int64)
            for part in np.unique(place // part_bits).tolist():
                own = place[place // part_bits == part] % part_bits
                parts.setdefault(part, np.zeros(part_bits, bool))[own] = True
        for part, flags in parts.items():
            packed = np.packbits(flags, bitorder="little").tobytes()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], ["part", "bits"])

    top = F.shiftrightunsigned("key", 64 - bits) / part_bits
    parts = keys.select("key").repartition(MAP_PARTS, top.cast("int")).mapInArrow(run, "part int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for part, packed in parts.collect():
        begin = part * part_bits // 8
        out[begin : begin + part_bits // 8] |= np.frombuffer(packed, np.uint8)
    return out.tobytes()


def in_bit_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys' bits are set (always for a key that was put in)."""
    at = keys >> U(64 - (len(bits) * 8 - 1).bit_length())
    return (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
