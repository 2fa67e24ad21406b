"""Parts of the operators against plain versions, and the paths that small tables don't reach."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchpulse.llm import chat_format, common, induced_sort, language_id, packing, quality_classifier, quality_rules, simhash_dedup, suffix_dedup, text_stats
from matchpulse.llm.induced_sort import LeastBetween, TupleQueue, suffix_orders
from matchpulse.llm.minimal_hash import MinimalHash
from matchpulse.llm.oracle import ORACLE_SQL
from matchpulse.llm.queries import REGISTRY
from matchpulse.llm.text_stats import statistics
from matchpulse.sources.staging import staged
from tests.compare import compare
from tests.llm import brute


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, name) is None


@pytest.mark.parametrize("name", REGISTRY)
def test_query_has_an_id(name):
    assert name in entry.queries() and name.startswith("op")


def test_minimal_hash_numbers_without_gaps():
    r = np.random.default_rng(1)
    first, second = r.integers(0, 1 << 63, 5000).astype(np.uint64), r.integers(0, 1 << 63, 5000).astype(np.uint64)
    first[:50] = first[0]  # equal first halves
    number = MinimalHash(first, second).number(first, second)
    assert sorted(number.tolist()) == list(range(5000))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=20, max_size=20), max_size=40), st.integers(1, 30))
def test_suffix_orders(tmp_path_factory, texts, limit):
    folder = str(tmp_path_factory.mktemp("runs"))
    matrix = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, 20)
    batches = [(np.arange(i, min(i + 7, len(texts))), matrix[i : i + 7]) for i in range(0, len(texts), 7)]
    found = {}
    for column, ids, common_prefix in suffix_orders(batches, 20, [0, 1, 2, 7], folder, limit=limit):
        held = found.setdefault(column, ([], []))
        held[0].extend(texts[i][column:] for i in ids)
        held[1].extend(common_prefix.tolist())
    assert list(found) == ([7, 2, 1, 0] if texts else [])
    for column, (own, common_prefix) in found.items():
        assert own == sorted(x[column:] for x in texts)
        for (a, b), n in zip(itertools.pairwise(own), common_prefix[1:]):
            assert n == next((i for i in range(len(a)) if a[i] != b[i]), len(a))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=300), st.integers(1, 40), st.randoms())
def test_least_between_on_disk(tmp_path_factory, values, span, r):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(induced_sort, "SPAN", span)
        least = LeastBetween(str(tmp_path_factory.mktemp("least")))
        for i in range(0, len(values), 13):
            least.append(np.array(values[i : i + 13]))
        least.finish()
        pairs = [sorted((r.randrange(len(values)), r.randrange(len(values)))) for _ in range(60)]
        got = least(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [min(values[a : b + 1]) for a, b in pairs]


def test_sort_holds_a_bounded_part_of_a_large_shard(tmp_path):
    """Ten and twenty times as many suffixes as are held take the same memory."""
    r = np.random.default_rng(3)

    def peak(n, limit=4_000, width=23):
        texts = r.integers(97, 100, (n, width)).astype(np.uint8)
        texts[n // 2 :] = texts[: n - n // 2]
        batches = ((np.arange(i, min(i + 1000, n)), texts[i : i + 1000]) for i in range(0, n, 1000))
        tracemalloc.start()
        held = tracemalloc.get_traced_memory()[0]
        equal = sum(int((common == width).sum()) for _, _, common in suffix_orders(batches, width, [0], str(tmp_path), limit=limit))
        most = tracemalloc.get_traced_memory()[1] - held
        tracemalloc.stop()
        assert equal >= n // 2
        return most

    small, large = peak(40_000), peak(80_000)
    assert large < 4_000 * 47 * 15 and large < 1.5 * small


def test_queue_merges_runs_from_disk(tmp_path):
    kind = np.dtype([("head", "u8"), ("rank", "i8"), ("id", "i8"), ("text", "u1", (3,))])
    queue, r = TupleQueue(kind, str(tmp_path), 10), np.random.default_rng(2)
    tuples = np.zeros(1000, kind)
    tuples["head"], tuples["rank"] = r.integers(0, 9, 1000), r.integers(0, 9, 1000)
    for i in range(0, 1000, 7):
        queue.push(tuples[i : i + 7])
    assert len(queue.runs) > 50
    found = np.concatenate(list(queue.pop()))
    assert [(a, b) for a, b in zip(found["head"], found["rank"])] == sorted(zip(tuples["head"], tuples["rank"]))


def test_repeats_in_hostile_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)  # most shared parts count as hot
    r = random.Random(3)
    passage = "".join(r.choice("abcdefghij ") for _ in range(130))
    texts = ["".join(r.choice("ab") for _ in range(400)) for _ in range(6)]
    texts += [texts[0][:150] + "-" + texts[0][20:], "a" * 900, "a" * 350, "ab" * 200, "aab" * 150, "", None, "\x00" * 250, "\x00" * 120]
    texts += ["".join(r.choice("xyz") for _ in range(r.randint(0, 60))) + passage[: r.randint(95, 130)] + "".join(r.choice("xyz") for _ in range(20)) for _ in range(30)]
    texts += [passage[i:] + passage[:i] for i in range(0, 60, 7)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = staged(common.numbered(df), "hostile")
    found = suffix_dedup.without_repeats(table)
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, brute.sha(bytes(x.kept))) for x in found.collect())
    assert got == brute.repeats(rows)


def test_equal_regions_are_settled_in_their_block(spark):
    texts = [(0, "a" * 50_000), (1, "ab" * 20_000), (2, "a" * 30_000), (None, "a" * 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    table = staged(common.numbered(df), "periodic")
    packed = suffix_dedup.packed_regions(table, 100, 32).where("shard >= 0").collect()
    assert sum(len(x["keys"]) // 8 for x in packed) < 1000  # of some 120,000 regions
    found = suffix_dedup.without_repeats(table).collect()
    got = sorted(((x.doc_id is None, x.doc_id), x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in found)
    assert got == [
        ((False, 0), 50_000, 49_999, 1, b"a"), ((False, 1), 40_000, 39_998, 1, b"ab"),
        ((False, 2), 30_000, 30_000, 1, b""), ((True, None), 300, 300, 1, b""),
    ]


def test_every_pair_within_the_distance_meets():
    for step in simhash_dedup.STEPS:
        masks = simhash_dedup.covering_masks(4, step)
        assert len(masks) == 31
        r = random.Random(4)
        for _ in range(3000):
            bits = sum(1 << b for b in r.sample(range(64), 4))
            assert any(m & bits == 0 for m in masks)


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET", 5)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(40)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash_dedup.near_links(spark.createDataFrame([(p,) for p in prints], "bits long"), 4)
    got = {x.bits: x.root for x in simhash_dedup.components(links).collect()}
    label = brute.components([(p, p & (1 << 64) - 1) for p in prints], 4)
    assert [got.get(p, p) for p in prints] == label


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="</s>INT[]\\\n<SYS", max_size=40), st.text(alphabet="rol\\\n<s>", max_size=10))
def test_chat_round_trip(text, role):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert not any(c in chat_format.escape(text) for c in chat_format.CONTROLS)
    formatted = (chat_format.header(role) + chat_format.escape(text) + chat_format.CLOSE) * 2
    assert chat_format.read_turns(formatted) == [(role, text)] * 2


def test_forward_sums_all_segmentations():
    pieces = tuple(sorted({b" ", b"a", b"b", b"c", b" a", b"ab", b"abc", b"bc", b" ab"}))
    trie, r = language_id.Trie(pieces), np.random.default_rng(6)
    probability = r.random((len(pieces), 2))
    words = [b" abc", b" aab", b" cab", b" bbb"]

    def total(word, k):
        if not word:
            return 1.0
        return sum(probability[i, k] * total(word[len(p) :], k) for i, p in enumerate(pieces) if word.startswith(p))

    got = language_id.forward(trie, np.frombuffer(b"".join(words), np.uint8).reshape(4, 4), probability)
    assert np.allclose(got, [[total(w, k) for k in range(2)] for w in words])
    found, weight = language_id.expected_counts(trie, np.frombuffer(b" abc", np.uint8).reshape(1, 4), np.array([1.0]), 0.1)
    sizes = np.array([len(p) for p in pieces])
    assert math.isclose((sizes[found] * weight).sum(), 4)  # every byte lies in one piece


def test_long_runs_are_summed_over_all_segmentations():
    assert {b" relationship", " университе".encode()} <= set(language_id.vocabulary())
    r = random.Random(12)
    pieces = {bytes([b]) for b in range(256)} | {b" a", b"ab", b"bc", b" ca", "né".encode(), b"abcabcabcabcabcab", b"cccccccccccccccccccccccccc"}
    pieces = tuple(sorted(pieces))
    trie, probability = language_id.Trie(pieces), np.random.default_rng(13).random((len(pieces), 2))
    texts = ["".join(r.choice(["ab", "c", "é", "n", "abcabcabc", "漢", "c" * 9]) for _ in range(r.randint(1, 400))) for _ in range(40)]
    texts += ["a " + texts[0] + " abc", "", None, "c" * 3000, "漢字" * 2000]
    words = language_id.Words(trie, pa.array(texts, pa.string()))
    logs = np.zeros((len(words.at), 2))
    counts = np.zeros(len(pieces))
    for rows, matrix in words.matrices():
        logs[rows] = language_id.log_sums(trie, matrix, probability)
        found, weight = language_id.expected_counts(trie, matrix, words.times[rows], 0.1)
        np.add.at(counts, found, weight)
    got = np.array([np.bincount(words.owners, logs[words.word, k], len(texts)) for k in range(2)]).T
    expected = np.zeros(len(pieces))
    for text, own in zip(texts, got):
        want = np.zeros(2)
        for word in (b" " + x.encode() for x in (text or "").split()):
            totals = np.array([brute.segmentations(word, pieces, probability[:, k]) for k in range(2)])
            want += totals
            expected += brute.piece_counts(word, pieces, 0.1)
        assert np.allclose(own, want, rtol=1e-9)
    assert np.allclose(counts, expected)


def test_more_languages_than_a_block(spark):
    r = random.Random(14)
    own = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)] for i in range(150)}
    texts = [(lang, " ".join(r.choices(words, k=6))) for lang, words in own.items() for _ in range(2)]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(2)
    model = language_id.fit(df, F.lit(True))
    assert model.languages == sorted(own)
    probability = np.concatenate([p for _, p in model.blocks()], axis=1)
    assert probability.shape == (len(model.pieces), 150) and np.allclose(probability.sum(axis=0), 1)
    trie, want = language_id.Trie(model.pieces), []
    for lang, text in texts:
        words = np.frombuffer("".join(f" {x}" for x in text.split()).encode(), np.uint8).reshape(6, 8)
        likely = np.log(language_id.forward(trie, words, probability)).sum(axis=0) + model.shares
        share = np.exp(likely - likely.max())
        want.append((lang, text, model.languages[likely.argmax()], 1 / share.sum()))
    got = sorted(language_id.identified(df.withColumn("copy", F.col("text")).select("lang", "copy", "text"), model).collect())
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in got], [x[3] for x in sorted(want)])
    assert sum(x.lang == x.lang_pred for x in got) > 290


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = entry.queries()["op2_language_id"](spark, sf).where("held_out").join(lang, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = entry.queries()["op7_quality_classifier"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.quality == r.predicted for r in found) >= 0.98 * len(found)
    rules = entry.queries()["op10_quality_rules"](spark, sf).where("NOT base_failed").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rules) >= 0.97 * len(rules)


def test_sample_does_not_depend_on_partitions(spark):
    r = random.Random(15)
    texts = [(i // 2, " ".join(r.choice(["the", "a", "Word", "x!", "12"]) for _ in range(r.randint(20, 60)))) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(300)], "doc_id long, quality int")
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        statistics = staged(text_stats.document_statistics(common.numbered(df)), "sample")
        sample = quality_classifier.labelled_sample(statistics, labels, F.lit(True), 100).drop("row")
        trees = quality_classifier.fit_quality(statistics, labels, F.lit(True), 100)
        x = np.random.default_rng(16).random((50, 14)) * 5
        found.append((sorted(sample.collect()), trees.scores(x).tolist(), quality_rules.fit_rules(statistics, labels, F.lit(True), 100)))
    assert 80 <= len(found[0][0]) <= 100 and found[0] == found[1]


def test_trees_learn_a_threshold_and_bear_one_class():
    r = np.random.default_rng(8)
    x = r.random((500, 3))
    y = ((x[:, 1] > 0.4) & (x[:, 2] < 0.7)).astype(float)
    trees = quality_classifier.fit(x, y)
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.97
    assert quality_classifier.fit(x, np.ones(500)).scores(x).min() > 0.99
    assert quality_classifier.fit(x[:0], y[:0]).scores(x).tolist() == [0.5] * 500


def test_rules_cover_in_order():
    r = np.random.default_rng(9)
    table = {"a": r.random(900), "b": r.random(900)}
    bad = (table["a"] > 0.8) | ((table["b"] < 0.2) & (table["a"] > 0.3))
    rules = quality_rules.learned_rules(table, bad)
    covered = np.zeros(900, bool)
    for rule in rules:
        covered[quality_rules.covers(rule, table, np.arange(900))] = True
    assert rules and (covered == bad).mean() > 0.95
    assert quality_rules.learned_rules(table, np.zeros(900, bool)) == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\t!|Aé", max_size=120))
def test_counts_of_a_text(text):
    found = statistics(pa.array([text, None, text + " x"], pa.string()))
    for i, own in enumerate((text, "", text + " x")):
        got = tuple(int(found[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == brute.counts(own)
        assert found["n_chars"][i] == len(own) and found["n_distinct_words"][i] == len(set(own.split()))
    assert set(found) == set(text_stats.COUNTS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80), st.integers(32, 40))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = {n: lengths.count(n) for n in lengths}
    plan = packing.packing_plan(counts, capacity)
    bins: dict[int, list[tuple[int, int]]] = {}
    for i, (length, first, each, begin, offset) in enumerate(plan.tolist()):
        last = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == length else counts[length]
        for k in range(first, last):
            bins.setdefault(begin + (k - first) // each, []).append((offset + (k - first) % each * length, length))
    assert sum(map(len, bins.values())) == len(lengths)
    for own in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= capacity
    assert len(bins) == brute.packs(lengths, capacity)


def test_ids_equal_those_of_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a<|endoftext|>b", "  \n\n\t x  ", "é漢字🙂\x00\x7f", "don't 123,456 ___ " * 50, "z" * 3000, " " * 500, "Straße ñandú\r\n"):
        assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_ids_of_very_long_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 2_000_000 + "x", "a" + "\n" * 2_000_000, "a b" + " \n" * 600_000 + "<|endoftext|>\u3000 c"):
        assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_ids_around_long_runs(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "LONG_RUN", 4)
    tokenizer, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(11)
    parts = ["    ", "     ", "\n\n\n\n", "\n\n\n\n\n ", "\t   \r\n", "\u3000\xa0\x85\u2028", "\x1c\x1d\x1e\x1f", " ", "<|endoftext|>", "ab", "1", "!", "é", "'s"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text
