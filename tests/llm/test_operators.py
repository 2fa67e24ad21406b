"""Every registered query of the operators over small tables, next to a plain version."""

import gzip
import hashlib
import itertools
import random
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from matchpulse.llm import warc
from matchpulse.llm.queries import REGISTRY
from tests.llm import brute
from tests.llm.conftest import write_tables


def rows(spark, name, folder, *columns):
    found = entry.queries()[name](spark, folder)
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=lambda x: tuple(map(brute.key, x)))


def ordered(values):
    return sorted(values, key=lambda x: tuple(map(brute.key, x)))


def table(folder, name, *columns):
    import pyarrow.parquet as pq

    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{folder}/{name}.parquet").to_pylist()]


@pytest.mark.parametrize("name", [*REGISTRY, "pipeline"])
def test_empty_tables(spark, empty, name):
    assert entry.queries()[name](spark, empty).count() == (1 if name.startswith("op5") else 0)


def test_decontamination(spark, nasty, documents):
    got = rows(spark, "op1_benchmark_decontamination", nasty, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == ordered(brute.contamination(documents, table(nasty, "benchmark", "item_id", "text")))
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_language(spark, nasty, documents):
    got = rows(spark, "op2_language_id", nasty, "doc_id", "held_out", "lang_pred", "score")
    assert len(got) == len(documents) and all(0 <= r[3] <= 1 for r in got)
    assert {r[0] for r in got if r[2] == "und"} == {None, 60, 61, 62, 66, 67}
    assert all(r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in got)


def test_repeated_strings(spark, nasty, documents):
    got = rows(spark, "op3_suffix_dedup", nasty, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    # of rows without id the row numbers decide, which follow the file here
    assert got == ordered(brute.repeats(documents))


def test_near_duplicates(spark, nasty, documents):
    prints = [(doc_id, brute.fingerprint(text)) for doc_id, text in documents]
    want = [(d, f"{p:016x}", c) for (d, p), c in zip(prints, brute.components(prints, 4))]
    assert rows(spark, "op4_simhash_near_dedup", nasty, "doc_id", "fingerprint", "component_id") == ordered(want)


def test_chat(spark, nasty):
    turns = table(nasty, "conversations", "conv_id", "turn", "role", "text")
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    order = lambda t: tuple((v is not None, v) if v is not None else (False, 0) for v in t)  # noqa: E731 nulls first
    want = []
    for conv_id, own in itertools.groupby(sorted(turns, key=lambda t: order(t)), key=lambda t: t[0]):
        own = [(r or "", t or "", r) for _, _, r, t in own]
        loss = "".join(t for _, t, r in own if r == "assistant")
        want.append((conv_id, len(own), brute.sha("".join(f"{r}\n{t}\n" for r, t, _ in own)), len(loss), brute.sha(loss)))
    assert rows(spark, "op5_chat_formatting", nasty, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == ordered(want)


def test_lines(spark, nasty, documents):
    got = rows(spark, "op6_line_dedup", nasty, "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == ordered(brute.lines(documents)) and any(r[2] for r in got)


def test_quality(spark, nasty, documents):
    got = rows(spark, "op7_quality_classifier", nasty, "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(documents)
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for _, _, s, p in got)
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, h, _, _ in got)


def pieces(documents):
    """doc_id, piece, length by the tokenizers library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in documents:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        first = n % 1024 or 1024
        for i, length in enumerate([first] + [1024] * ((n - first) // 1024)):
            yield doc_id, i, length


def test_packing(spark, nasty, documents):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, lengths = [], []
    for doc_id, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            lengths.append(b - a)
    assert rows(spark, "op8_best_fit_packing", nasty, "doc_id", "piece", "start", "length", "ids_crc32") == ordered(want)
    got = rows(spark, "op8_best_fit_packing", nasty, "sequence_id", "offset", "length")
    for _, own in itertools.groupby(got, key=lambda r: r[0]):
        at = 0
        for _, offset, length in own:
            assert offset == at
            at += length
        assert at <= 1024
    assert len({r[0] for r in got}) == brute.packs(lengths, 1024)


def test_warc(spark, nasty):
    pages = table(nasty, "pages", "page_id", "html")
    least = {}
    for page_id, html in pages:
        if page_id is not None:
            least[html or ""] = min(page_id, least.get(html or "", page_id))
    want = []
    for page_id, html in pages:
        data = (html or "").encode()
        first = least.get(html or "") if len(data) >= 100 else None
        revisit = first is not None and first != page_id
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(spark, "op9_warc_revisits", nasty, *columns) == ordered(want)


def test_archives_of_long_pages_hold_few_records(spark, tmp_path):
    """Each class of sizes has its own archives; all of them are read back."""
    sizes = [10, 31_999, 32_000, 999_999, 1_000_000, 3_000_000]
    pages = [(100 * k + i, "u", chr(97 + i % 20) * n) for k, n in enumerate(sizes) for i in range(70 if n == 32_000 else 3)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(table, f"{tmp_path}/w")
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz")]
    for data in files:
        held = [size for _, _, size, *_ in warc.parse(data)]
        assert sum(held) < 64_000_000 and (max(held) < 1_000_000 or len(held) == 1) and (max(held) < 32_000 or len(held) <= 64)
    found = warc.read_archives(spark, f"{tmp_path}/w").select("page_id", "payload_bytes", "record_type").collect()
    assert sorted((r[0], r[1]) for r in found) == sorted((p, len(h)) for p, _, h in pages)
    assert sum(r[2] == "response" for r in found) == 3 + len({h for _, _, h in pages if len(h) > 10})


def test_a_very_long_text(spark, tmp_path, documents):
    """One text of some megabytes beside the others, through the operators that have a plain version."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(20_000)]
    text = "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(40_000)) + "\n" + documents[32][1]
    rows_ = [(1000, text), (1001, text), *documents[:40]]
    folder = write_tables(tmp_path, rows_, [(1, " ".join(text.split()[300_000:300_030]))], [(1, "u", text), (2, "u", text)], [(1, 1), (2, 0)], [(1, 0, "assistant", text)])
    got = rows(spark, "op1_benchmark_decontamination", folder, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == ordered(brute.contamination(rows_, [(1, " ".join(text.split()[300_000:300_030]))]))
    prints = [(d, brute.fingerprint(t)) for d, t in rows_]
    want = [(d, f"{p:016x}", c) for (d, p), c in zip(prints, brute.components(prints, 4))]
    assert rows(spark, "op4_simhash_near_dedup", folder, "doc_id", "fingerprint", "component_id") == ordered(want)
    got = rows(spark, "op5_chat_formatting", folder, "conv_id", "loss_chars", "loss_sha256")
    assert (1, len(text), brute.sha(text)) in got
    assert rows(spark, "op6_line_dedup", folder, "doc_id", "n_lines", "n_dropped", "kept_sha256") == ordered(brute.lines(rows_))
    got = rows(spark, "op9_warc_revisits", folder, "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == [(1, len(text), "response", None), (2, len(text), "revisit", 1)]
    got = rows(spark, "op10_quality_rules", folder, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == ordered((d, *brute.counts(t)) for d, t in rows_)


def test_chat_sql(spark, nasty):
    from tests.compare import compare

    assert compare(spark, nasty, "op5_chat_formatting") is None


def test_rules(spark, nasty, documents):
    got = rows(spark, "op10_quality_rules", nasty, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for doc_id, text in documents:
        own = brute.counts(text)
        want.append((doc_id, *own, own[0] < 20 or 100 * own[4] > 30 * own[0]))
    assert got == ordered(want)
    kept = rows(spark, "op10_quality_rules", nasty, "base_failed", "kept")
    assert all(not (failed and keep) for failed, keep in kept) and any(keep for _, keep in kept)


def test_pipeline_stages(spark, nasty, documents):
    """Each stage takes out just what a plain version takes out of its own input."""
    docs = spark.read.parquet(f"{nasty}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        # the stage's result is read back, as run() does
        before = [(r.doc_id, r.text) for r in docs.collect()]
        found = stage(spark, docs, nasty)
        folder = f"{nasty}/stage-{name.replace(' ', '-')}"
        found.write.mode("overwrite").parquet(folder)
        docs = spark.read.parquet(folder)
        after = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (brute.key(x[0]), brute.key(x[1]))) if "text" in docs.columns else None
        if name == "quality classifier":
            scores = rows(spark, "op7_quality_classifier", nasty, "doc_id", "predicted")
            assert ordered((d,) for d, _ in after) == [(d,) for d, kept in scores if kept]
        elif name == "line dedup":
            assert sorted(brute.sha(t or "") for _, t in after) == sorted(x[3] for x in brute.lines(before))
        elif name == "simhash near-dedup":
            prints = [(d, brute.fingerprint(t)) for d, t in before]
            groups = brute.components([(i, p) for i, (_, p) in enumerate(prints)], 4)
            assert len(after) == len(set(groups))
            assert {d for d, _ in after if d is not None} == {c for c in brute.components(prints, 4) if c is not None}
        elif name == "benchmark decontamination":
            hit = {d for d, *_, c in brute.contamination(before, table(nasty, "benchmark", "item_id", "text")) if c}
            assert {d for d, _ in after} == {d for d, _ in before} - hit
        elif name == "best-fit packing":
            found = docs.collect()
            assert ordered((r.doc_id, r.piece, r.length) for r in found) == ordered(pieces(before))
            assert len({r.sequence_id for r in found}) == brute.packs([r.length for r in found], 1024)
        if after is not None:
            assert docs.columns == columns
