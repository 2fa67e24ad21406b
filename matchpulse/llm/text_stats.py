"""Counts that describe a text, made for a whole Arrow batch in numpy passes over its bytes.

Words are runs without ASCII white space. Null and empty texts have zeros everywhere, but one line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchpulse.llm import common as C

REPEAT_WINDOW = 8

COUNTS = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
    "n_digits", "n_marks", "n_stops", "n_beyond", "n_twin_words", "n_distinct_words", "longest_word",
)
SCHEMA = "row bigint, doc_id bigint, " + ", ".join(f"{name} bigint" for name in COUNTS)


def _bytes_in(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


HEAD = np.ones(256, dtype=bool)  # the first byte of a character
HEAD[128:192] = False
TABLES = {
    "n_chars": HEAD,
    "word_chars": HEAD & C.SOLID,
    "n_symbols": _bytes_in(b"#*$%&|<>"),
    "n_upper": _bytes_in(bytes(range(65, 91))),
    "n_digits": _bytes_in(b"0123456789"),
    "n_marks": _bytes_in(b"!?"),
    "n_stops": _bytes_in(b".,;:"),
    "n_beyond": HEAD & (np.arange(256) >= 128),
}


def _owned(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Keys that differ between owners."""
    return C.mixed(keys + C.mixed(owners.astype(C.U) + C.U(1)))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of an Arrow column."""
    n = len(column)
    data, offsets = C.flat(column)
    out = {k: np.add.reduceat(t[data].view(np.uint8), offsets[:-1], dtype=np.int64) for k, t in TABLES.items()}
    out["n_chars"] -= 1  # the newline put after each text

    starts, ends = C.words(data, C.SOLID)
    bounds = np.searchsorted(starts, offsets)
    out["n_words"] = np.diff(bounds)
    owners = np.repeat(np.arange(n), out["n_words"])
    hashes = C.word_hashes(data, starts, ends)
    sizes = np.zeros(n, np.int64)
    np.maximum.at(sizes, owners, ends - starts)
    out["longest_word"] = sizes
    twins = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1]))
    out["n_twin_words"] = np.bincount(owners[twins], minlength=n)
    _, first = np.unique(_owned(hashes, owners), return_index=True)
    out["n_distinct_words"] = np.bincount(owners[first], minlength=n)

    covered = np.zeros(len(starts) + 1, np.int64)
    places = np.flatnonzero(np.arange(len(starts)) + REPEAT_WINDOW <= np.repeat(bounds[1:], out["n_words"]))
    if len(places):
        keys = np.zeros(len(places), C.U)
        for i in range(REPEAT_WINDOW):
            keys = keys * C.BASE + hashes[places + i]
        again = places[_repeated(_owned(keys, owners[places]))]
        covered[again] += 1
        np.add.at(covered, again + REPEAT_WINDOW, -1)
    inside = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(owners[inside], minlength=n)

    lines = data.tobytes().split(b"\n")
    counts = np.add.reduceat((data == 10).view(np.uint8), offsets[:-1], dtype=np.int64)
    out["n_lines"] = counts
    edges = np.r_[0, np.cumsum(counts)].tolist()
    repeats = np.zeros(n, np.int64)
    for i in np.flatnonzero(counts > 1).tolist():
        own_lines = lines[edges[i] : edges[i + 1]]
        if len(set(own_lines)) < len(own_lines):
            seen: set[bytes] = set()
            for line in own_lines:
                repeats[i] += line in seen and bool(line.strip())
                seen.add(line)
    out["n_dup_lines"] = repeats
    return out


def document_statistics(documents: DataFrame) -> DataFrame:
    """row, doc_id and the counts of every row of (row, doc_id, text)."""

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole, "text"):
                found = statistics(batch.column("text"))
                yield pa.record_batch(
                    [batch.column("row"), batch.column("doc_id"), *(pa.array(found[k], pa.int64()) for k in COUNTS)],
                    ["row", "doc_id", *COUNTS],
                )

    return documents.select("row", "doc_id", "text").mapInArrow(run, SCHEMA)
