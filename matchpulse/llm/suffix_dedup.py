"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (smaller doc_id, or the
same document and an earlier start). Matches never cross documents.

*Sharding.* Equal strings must meet in one shard, wherever they stand. Of the short strings (``GRAM``
bytes) inside a string of ``length`` bytes the one of the least hash is its anchor; it depends on the
string alone. Neighbouring strings with one anchor form a region. Regions go to shards by
their anchor as packed arrays of hashes, not text; of equal regions of a block of rows only the first goes to a
shard, the others are settled at once. A region whose bytes (128 bits of hashes) stand earlier too is settled there, for all its strings, and only the first of equal regions goes on, and only
if another region shares its anchor. Those are cut to stretches of ``STRETCH`` strings and settled
again by the bytes that all strings of a stretch share. What is left is where repeats begin and end.

*Sorting.* The bytes of the stretches left go to shards by the bytes they share. A shard sorts the suffixes
at all their strings by external induced sorting (``induced_sort``): tuples in disk-backed queues, with
common prefixes carried along. Neighbours that share ``length`` bytes are equal strings; all but the
earliest of such a run go. A shared part with more than ``HOT`` stretches is split into single strings, salted by
their hash, so that equal ones stay together and no shard grows with it.

Texts travel only for rows that a bit map of fixed size marks as concerned.

A null text is empty. Rows with equal ids count as documents in the order of their row numbers, rows
without id come after all others. Removal may cut characters, so kept text is binary. Empty tables stay
empty.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchpulse.llm import common as C
from matchpulse.llm.induced_sort import suffix_orders
from matchpulse.sources.staging import staged

LENGTH = 100
GRAM = 32
STRETCH = 8
HOT = 500
SALTS = 64
BLOCK_BITS = 11
CHUNK = 4_000_000
PLACE_BITS = 23
SHARD_ROWS = 10_000
SHARD_BYTES = 32_000_000
MIN_SHARDS = 32
#: Bytes of text that a task reads beside what was found in it, on average.
TASK_BYTES = 16_000_000
MIN_PARTS = 8
LAST_ID = np.iinfo(np.int64).max

REMOVED, SHARED, HOT_SHARED = 0, 1, 2
#: Strings from ``start`` to ``start + size`` of a row of a block; ``turn`` is the anchor's distance from start.
META = np.dtype([("row", "u2"), ("start", "u4"), ("size", "u1"), ("turn", "u1")])
PACKED = "shard int, block bigint, keys binary, hashes binary, ids binary, meta binary"
FOUND = "block bigint, kind int, meta binary"


def rolling_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes."""
    up, down = C.POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, C.U)
    np.cumsum((data.astype(C.U) + C.U(1)) * up[: len(data)], out=sums[1:])
    n = len(data) - size + 1
    return C.mixed((sums[size:] - sums[:n]) * down[:n])


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` hashes the place of the least (of its upper bits; the first of equals)."""
    n = len(hashes)
    ranked = (hashes >> C.U(PLACE_BITS) << C.U(PLACE_BITS)) | np.arange(n, dtype=C.U)
    blocks = np.concatenate([ranked, np.full(-n % window, ~C.U(0))]).reshape(-1, window)
    to_left = np.minimum.accumulate(blocks, axis=1).ravel()
    to_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(to_right[: n - window + 1], to_left[window - 1 : n])
    return (least & C.U((1 << PLACE_BITS) - 1)).astype(np.int64)


def regions(data: np.ndarray, offsets: np.ndarray, length: int):
    """Regions of texts in flat bytes, by stretches: text, first and last string, anchor, hashes of anchor and bytes."""
    for chunk in range(0, max(0, len(data) - length), CHUNK):
        own = data[chunk : chunk + CHUNK + length - 1]
        if len(own) < length:
            continue
        hashes = rolling_hashes(own, GRAM)
        anchor = anchors(hashes, length - GRAM + 1)
        start = np.arange(len(anchor))
        text = np.searchsorted(offsets, start + chunk, "right") - 1
        inside = start + chunk + length <= offsets[text + 1] - 1
        start, anchor, text = start[inside], anchor[inside], text[inside]
        if not len(start):
            continue
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        first, last = start[new], start[np.r_[new[1:], len(start)] - 1]
        anchor, text = anchor[new], text[new]
        bytes_hash = C.range_hashes(own, first, last + length) ^ C.mixed((anchor - first).astype(C.U))
        yield text, first + chunk, last + chunk, anchor + chunk, hashes[anchor], bytes_hash


def _pack(block: int, shards: int, keys, hashes, ids, meta, turn: int | None = None):
    """Rows of PACKED: the entries of a block by shard; of equal ones the first, the others in rows of shards below 0."""
    small = zstandard.ZstdCompressor(level=1).compress
    order = np.lexsort((meta["start"], meta["row"], ids, hashes, keys))
    keys, hashes, ids, meta = (x[order] for x in (keys, hashes, ids, meta))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])
    if not new.all():
        spread = block if turn is None else turn
        yield -1 - spread % shards, block, b"", b"", b"", small(meta[~new].tobytes())
    keys, hashes, ids, meta = (x[new] for x in (keys, hashes, ids, meta))
    shard = (keys % C.U(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    keys, hashes, ids, meta, shard = (x[order] for x in (keys, hashes, ids, meta, shard))
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(shard[a]), block, keys[a:b].tobytes(), hashes[a:b].tobytes(), small(ids[a:b].tobytes()), small(meta[a:b].tobytes())


def _record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _meta(row, start, size, turn) -> np.ndarray:
    out = np.empty(len(row), META)
    out["row"], out["start"], out["size"], out["turn"] = row, start, size, turn
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def packed_regions(table: DataFrame, length: int, shards: int) -> DataFrame:
    """The regions of all texts, packed by block of rows and shard."""

    def run(batches):
        block, held, count, turn = None, [], 0, TaskContext.get().partitionId()

        def flush():
            if held:
                yield _record_batch(list(_pack(block, shards, *(np.concatenate(x) for x in zip(*held)), turn)), PACKED)

        for whole in batches:
            for batch in C.slices(whole, "text"):
                data, offsets = C.flat(batch.column("text"))
                rows, ids = batch.column("row").to_numpy(), _ids(batch.column("doc_id"))
                for text, first, last, anchor, key, own in regions(data, offsets, length):
                    meta = _meta(rows[text] & (1 << BLOCK_BITS) - 1, first - offsets[text], last - first, anchor - first)
                    blocks = rows[text] >> BLOCK_BITS
                    for b in np.unique(blocks).tolist():
                        if b != block or count > 1_000_000:
                            yield from flush()
                            block, held, count, turn = b, [], 0, turn + 1
                        at = blocks == b
                        held.append((key[at], own[at], ids[text[at]], meta[at]))
                        count += int(at.sum())
        yield from flush()

    return table.select("row", "doc_id", "text").mapInArrow(run, PACKED)


def settled(packed: DataFrame) -> DataFrame:
    """Per block what is removed (equal bytes stand earlier) and what must be looked at (a key shared by others)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        expand = zstandard.ZstdDecompressor().decompress
        if frame["shard"].iat[0] < 0:  # settled inside their blocks
            known = [(b, REMOVED, expand(x)) for b, x in zip(frame["block"], frame["meta"])]
            return pd.DataFrame(known, columns=["block", "kind", "meta"])
        key = np.concatenate([np.frombuffer(x, C.U) for x in frame["keys"]])
        own = np.concatenate([np.frombuffer(x, C.U) for x in frame["hashes"]])
        ids = np.concatenate([np.frombuffer(expand(x), np.int64) for x in frame["ids"]])
        sizes = np.array([len(x) // 8 for x in frame["keys"]])
        meta = np.concatenate([np.frombuffer(expand(x), META) for x in frame["meta"]])
        block = np.repeat(frame["block"].to_numpy(), sizes)

        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        at = np.sort(order[np.r_[same, False] | np.r_[False, same]])  # keys that occur again
        at = at[np.lexsort((meta["start"][at], meta["row"][at], block[at], ids[at], own[at], key[at]))]
        new_key = np.r_[True, key[at][1:] != key[at][:-1]][: len(at)]
        new = new_key | np.r_[True, own[at][1:] != own[at][:-1]][: len(at)]
        group = np.cumsum(new_key) - 1
        several = np.bincount(group[new], minlength=1)[group] if len(at) else np.zeros(0, np.int64)
        kind = np.where(~new, REMOVED, np.where(several > HOT, HOT_SHARED, np.where(several > 1, SHARED, -1)))
        out = []
        for k in (REMOVED, SHARED, HOT_SHARED):
            out += [(b, k, x) for b, x in _by_block(block[at][kind == k], meta[at][kind == k])]
        return pd.DataFrame(out, columns=["block", "kind", "meta"])

    return packed.groupBy("shard").applyInPandas(run, FOUND)


def _by_block(block: np.ndarray, meta: np.ndarray):
    order = np.argsort(block, kind="stable")
    block, meta = block[order], meta[order]
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(block[a]), meta[a:b].tobytes()


def concerned_rows(found: DataFrame, kinds: tuple[int, ...]) -> bytes:
    """A bit map of the rows that the found entries of some kinds belong to."""

    def run(batches):
        for batch in batches:
            for block, meta in zip(batch.column("block").to_pylist(), batch.column("meta").to_pylist()):
                rows = np.unique(np.frombuffer(meta, META)["row"]).astype(np.int64) + (block << BLOCK_BITS)
                yield pa.record_batch([pa.array(C.mixed(rows.view(C.U)).view(np.int64))], ["key"])

    return C.bit_map(found.where(F.col("kind").isin(*kinds)).select("block", "meta").mapInArrow(run, "key bigint"))


def _marked(table: DataFrame, bits: bytes):
    """A column that tells whether a row may be concerned."""
    shared = table.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def marked(row: pd.Series) -> pd.Series:
        return pd.Series(C.in_bit_map(np.frombuffer(shared.value, np.uint8), C.mixed(row.to_numpy(np.int64).view(C.U))))

    return marked("row")


def beside(table: DataFrame, found: DataFrame, run, schema: str, parts: int) -> DataFrame:
    """Bring found entries to their texts, in ``parts`` tasks: ``run(row, doc_id, text, kinds, meta)`` for each batch of texts.

    Batches are slices of rows of one block; kinds and meta are the block's entries of their rows,
    in the order of rows, and meta's rows are places in the batch.
    """
    none = F.lit(None)
    both = table.select(
        F.shiftright("row", BLOCK_BITS).alias("block"), F.lit(9).alias("kind"), "row", "doc_id", "text", none.cast("binary").alias("meta")
    ).unionByName(
        found.select(
            "block", "kind", none.cast("long").alias("row"), none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "meta"
        )
    )

    def rows(batches):
        block, kinds, metas = None, [], []
        for whole in batches:
            for batch in C.slices(whole, "text"):
                blocks = batch.column("block").to_numpy()
                is_text = batch.column("kind").to_numpy() == 9
                edges = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (is_text[1:] != is_text[:-1]), True])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    part = batch.slice(a, b - a)
                    if blocks[a] != block:
                        block, kinds, metas = blocks[a], [], []
                    if not is_text[a]:
                        for kind, packed in zip(part.column("kind").to_pylist(), part.column("meta").to_pylist()):
                            metas.append(np.frombuffer(packed, META))
                            kinds.append(np.full(len(metas[-1]), kind))
                        continue
                    meta = np.concatenate(metas) if metas else np.zeros(0, META)
                    kind = np.concatenate(kinds) if kinds else np.zeros(0, np.int64)
                    metas, kinds = [meta], [kind]
                    own = part.column("row").to_numpy() & (1 << BLOCK_BITS) - 1
                    place = np.full(1 << BLOCK_BITS, -1)
                    place[own] = np.arange(len(own))
                    at = place[meta["row"]]
                    here = np.flatnonzero(at >= 0)
                    here = here[np.argsort(at[here], kind="stable")]
                    mine = meta[here].copy()
                    mine["row"] = at[here]
                    yield from run(part.column("row"), part.column("doc_id"), part.column("text"), kind[here], mine)

    return both.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(rows, schema)


def _stretches(offsets: np.ndarray, meta: np.ndarray):
    """Stretches of regions: region, number of the stretch, its last possible, first and last string."""
    first = offsets[meta["row"]] + meta["start"].astype(np.int64)
    last = first + meta["size"]
    anchor = first + meta["turn"]
    low, high = (anchor - last) // STRETCH, (anchor - first) // STRETCH
    count = high - low + 1
    region = np.repeat(np.arange(len(meta)), count)
    number = low[region] + np.arange(len(region)) - np.repeat(np.cumsum(count) - count, count)
    top = anchor[region] - STRETCH * number
    return region, number, top, np.maximum(top - STRETCH + 1, first[region]), np.minimum(top, last[region])


def packed_stretches(table: DataFrame, found: DataFrame, length: int, shards: int, parts: int) -> DataFrame:
    """The stretches of shared regions, packed by block and by the bytes that all their strings hold."""

    def run(row, doc_id, text, kinds, meta):
        meta = meta[kinds != REMOVED]
        if not len(meta):
            return
        data, offsets = C.flat(text)
        region, number, top, first, last = _stretches(offsets, meta)
        key = C.range_hashes(data, top, top - STRETCH + 1 + length) ^ C.mixed(number.astype(C.U) + C.U(1))
        own = C.range_hashes(data, first, last + length) ^ C.mixed((top - first).astype(C.U) + C.U(1))
        at = meta["row"][region]
        rows = row.to_numpy()
        entries = _meta(rows[at] & (1 << BLOCK_BITS) - 1, first - offsets[at], last - first, top - first)
        out = list(_pack(int(rows[0]) >> BLOCK_BITS, shards, key, own, _ids(doc_id)[at], entries))
        yield _record_batch(out, PACKED)

    return beside(table, found, run, PACKED, parts)


TEXTS = "key bigint, doc_id bigint, row bigint, top bigint, first int, last int, text binary"


def stretch_texts(table: DataFrame, found: DataFrame, length: int, parts: int) -> DataFrame:
    """The bytes of the stretches to be sorted; a string starts at top - i for i from first to last."""
    width = length + STRETCH - 1

    def run(row, doc_id, text, kinds, meta):
        rows, ids = row.to_numpy(), _ids(doc_id)
        for hot in (False, True):
            own = meta[kinds == (HOT_SHARED if hot else SHARED)]
            if not len(own):
                continue
            data, offsets = C.flat(text)
            begin = offsets[own["row"]] + own["start"].astype(np.int64)
            top = begin + own["turn"]
            key = C.range_hashes(data, top, top - STRETCH + 1 + length)
            first, last = own["turn"].astype(np.int64) - own["size"], own["turn"].astype(np.int64)
            at = own["row"].astype(np.int64)
            if hot:  # each string by itself, salted by its hash
                count = last - first + 1
                which = np.repeat(np.arange(len(own)), count)
                step = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                top, at, begin = top[which] - step, at[which], top[which] - step
                salt = C.range_hashes(data, top, top + length) % C.U(SALTS)
                key = C.mixed(key[which] + step.astype(C.U) * C.U(SALTS) + salt)
                first = last = np.zeros(len(which), np.int64)
            place = top[:, None] + np.arange(1 - STRETCH, length)
            known = (place >= begin[:, None]) & (place < offsets[at + 1][:, None] - 1)
            texts = np.where(known, data[np.clip(place, 0, len(data) - 1)], 0).astype(np.uint8)
            yield pa.record_batch(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(ids[at]),
                    pa.array(rows[at]),
                    pa.array(top - offsets[at]),
                    pa.array(first, pa.int32()),
                    pa.array(last, pa.int32()),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(texts), [None, pa.py_buffer(texts.tobytes())]).cast(pa.binary()),
                ],
                [x.split()[0] for x in TEXTS.split(", ")],
            )

    return beside(table, found, run, TEXTS, parts)


#: What a suffix tuple carries: where its stretch lies, and which of its strings count.
PAYLOAD = np.dtype([("doc_id", "i8"), ("row", "i8"), ("top", "i8"), ("first", "i4"), ("last", "i4")])
STRING = np.dtype([("doc_id", "i8"), ("row", "i8"), ("start", "i8")])


def _repeats(strings: np.ndarray, run: np.ndarray, open_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings of each run all but the earliest; and the earliest of the run that goes on, if it has any."""
    order = np.lexsort((strings["start"], strings["row"], strings["doc_id"], run))
    strings, run = strings[order], run[order]
    again = np.zeros(len(run), bool)
    again[1:] = run[1:] == run[:-1]
    return strings[again], strings[~again & (run == open_run)]


def repeated_strings(texts: DataFrame, length: int, shards: int, limit: int | None = None) -> DataFrame:
    """Strings that also stand earlier, found in each of ``shards`` by external induced sorting; ``limit`` suffix tuples are held."""
    width = length + STRETCH - 1
    most = {} if limit is None else {"limit": limit}

    def matrices(batches):
        for batch in batches:
            own = np.empty(batch.num_rows, PAYLOAD)
            for name in PAYLOAD.names:
                own[name] = batch.column(name).to_numpy()
            yield own, np.frombuffer(b"".join(batch.column("text").to_pylist()), np.uint8).reshape(-1, width)

    def run(batches):
        with tempfile.TemporaryDirectory(prefix="induced-") as folder:
            at, held = None, np.zeros(0, STRING)
            for column, own, common in suffix_orders(matrices(batches), width, list(range(STRETCH)), folder, PAYLOAD, **most):
                if column != at:
                    at, held = column, held[:0]
                back = STRETCH - 1 - column
                runs = np.cumsum(common < length)
                real = (own["first"] <= back) & (back <= own["last"])
                strings = np.empty(int(real.sum()), STRING)
                strings["doc_id"], strings["row"], strings["start"] = own["doc_id"][real], own["row"][real], own["top"][real] - back
                # the earliest of the run that the last block left open has run 0, like what goes on with it here
                repeats, held = _repeats(np.concatenate([held, strings]), np.concatenate([np.zeros(len(held), np.int64), runs[real]]), runs[-1])
                meta = _meta(repeats["row"] & (1 << BLOCK_BITS) - 1, repeats["start"], 0, 0)
                out = [(b, REMOVED, x) for b, x in _by_block(repeats["row"] >> BLOCK_BITS, meta)]
                if out:
                    yield _record_batch(out, FOUND)

    return texts.repartition(shards, "key").mapInArrow(run, FOUND)


KEPT = "row bigint, doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def without_repeats(table: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes) of every row.

    ``table`` has row, doc_id, text and must be a written table: it is read several times.
    """
    if not GRAM + STRETCH < length < 256:
        raise ValueError(f"length must lie between {GRAM + STRETCH} and 256")
    C.bounded_batches(table.sparkSession)
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    shards = max(MIN_SHARDS, size["n"] // SHARD_ROWS, size["bytes"] // SHARD_BYTES)
    parts = max(MIN_PARTS, -(-size["bytes"] // TASK_BYTES))
    first = staged(settled(packed_regions(table, length, shards)), "repeats-regions")
    concerned = table.where(_marked(table, concerned_rows(first, (SHARED, HOT_SHARED))))
    second = staged(settled(packed_stretches(concerned, first.where(F.col("kind") != REMOVED), length, shards, parts)), "repeats-stretches")
    sharing = second.where(F.col("kind") != REMOVED)
    concerned = table.where(_marked(table, concerned_rows(second, (SHARED, HOT_SHARED))))
    third = staged(repeated_strings(stretch_texts(concerned, sharing, length, parts), length, shards), "repeats-strings")
    removed = first.unionByName(second).unionByName(third).where(F.col("kind") == REMOVED)
    marked = _marked(table, concerned_rows(removed, (REMOVED,)))

    def run(row, doc_id, text, kinds, meta):
        data, offsets = C.flat(text)
        begin = offsets[meta["row"]] + meta["start"].astype(np.int64)
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + meta["size"] + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        starts = gone & ~np.r_[False, gone[:-1]]
        n = len(row)
        count = np.add.reduceat(gone.view(np.uint8), offsets[:-1], dtype=np.int64)
        spans = np.add.reduceat(starts.view(np.uint8), offsets[:-1], dtype=np.int64)
        sizes = np.diff(offsets) - 1
        gone[offsets[1:] - 1] = True  # the newline put after each text
        kept = data[~gone].tobytes()
        ends = np.cumsum(sizes - count).tolist()
        texts = [kept[a:b] for a, b in zip([0, *ends], ends)]
        yield pa.record_batch(
            [row, doc_id, *(pa.array(x[:n], pa.int64()) for x in (sizes, count, spans)), pa.array(texts, pa.binary())],
            [x.split()[0] for x in KEPT.split(", ")],
        )

    changed = beside(table.where(marked), removed, run, KEPT, parts)
    text = F.coalesce("text", F.lit("")).cast("binary")
    zero = F.lit(0).cast("long")
    same = table.where(~marked).select(
        "row", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), text.alias("kept")
    )
    return changed.unionByName(same)
