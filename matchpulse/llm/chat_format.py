"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context and only its reply
trainable. A conversation that does not end with an assistant turn has one more example, the
whole conversation with nothing trainable, so that no turn is lost.

A turn is written ``<s>role<newline>text</s>``. Control strings inside roles and texts are broken by a
backslash after their first character, backslashes are doubled, and newlines in roles get a
backslash, so formatted text is read back to the same turns.

Turns are ordered by turn, then role and text (nulls first). A null text or role is empty. Rows without
conv_id are one conversation. Rows stream through a task in the order of their conversation; a task
holds one example at a time. Empty tables give no examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: Control strings of common templates.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = "assistant"
BATCH_CHARS = 4_000_000

EXAMPLES = "conv_id bigint, example int, n_turns bigint, text string, loss_start bigint, loss_end bigint"
READ = "conv_id bigint, example int, n_turns bigint, turns_sha256 string, loss string, formatted_chars bigint"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)


def escape(text: str | None) -> str:
    text = (text or "").replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def header(role: str | None) -> str:
    return OPEN + escape(role).replace("\n", "\\\n") + "\n"


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out = []
    for part in text.split(CLOSE)[:-1]:
        found = _ROLE.match(part, len(OPEN))
        out.append((unescape(found[1]), unescape(part[found.end() :])))
    return out


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), n_turns, text, and the trainable span [loss_start, loss_end) of text."""

    def of_conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
        conversation, parts, size, count, trained = None, [], 0, 0, True
        for conv_id, role, text in rows:
            if conversation is None or conv_id != conversation[0]:
                if not trained:
                    yield conversation[0], count, len(parts), "".join(parts), size, size
                conversation, parts, size, count = (conv_id,), [], 0, 0
            begin, body = header(role), escape(text)
            parts.append(begin + body + CLOSE)
            trained = role == TRAINED
            if trained:
                start = size + len(begin)
                yield conv_id, count, len(parts), "".join(parts), start, start + len(body)
                count += 1
            size += len(parts[-1])
        if not trained:
            yield conversation[0], count, len(parts), "".join(parts), size, size

    def run(batches):
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
        out, size = [], 0
        for example in of_conversations(rows):
            out.append(example)
            size += len(example[3])
            if size > BATCH_CHARS:
                yield _batch(out, EXAMPLES)
                out, size = [], 0
        if out:
            yield _batch(out, EXAMPLES)

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, EXAMPLES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def read_examples(formatted: DataFrame) -> DataFrame:
    """What each example says when read back: its turns' digest, the text under the mask, its size."""

    def run(batches):
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                conv_id, example, _, text, start, end = row
                turns = read_turns(text)
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                out.append((conv_id, example, len(turns), digest.hexdigest(), unescape(text[start:end]), len(text)))
            if out:
                yield _batch(out, READ)

    return formatted.mapInArrow(run, READ)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: its turns (from its longest example) and the text under all its masks."""
    read = read_examples(formatted)
    pieces = F.sort_array(F.collect_list(F.struct("example", "loss")))
    loss = F.array_join(F.transform("pieces", lambda x: x["loss"]), "")
    return (
        read.groupBy("conv_id")
        .agg(
            F.max_by(F.struct("n_turns", "turns_sha256"), "example").alias("whole"),
            pieces.alias("pieces"),
            F.sum("formatted_chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "whole.n_turns",
            "whole.turns_sha256",
            F.char_length(loss).cast("long").alias("loss_chars"),
            F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
