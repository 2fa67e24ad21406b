"""The manifest, ranked search and byte BPE against plain versions and on odd inputs."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from matchpulse.llm import byte_bpe, merkle, ranked_search
from tests.llm import brute
from tests.llm.test_operators import ordered, rows, table

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- manifest


def climb(nodes):
    """Top of a tree and for each lowest node its siblings, level by level, before and after."""
    ways, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for way, i in zip(ways, range(len(ways))):
            run, slot = runs[place[i] // 8], place[i] % 8
            way.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            place[i] //= 8
        level = [H(*run) for run in runs]
    return (level[0] if level else None), ways


def manifest(documents):
    def leaf(row, lower=False):
        values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] and row["text"].translate(LOW) if lower else row["text"]]
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for row in sorted(documents, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops = {lang: climb([leaf(r) for r in groups[lang]]) for lang in order}
    root, upper = climb([tops[lang][0] for lang in order])
    out = []
    for lang, above in zip(order, upper):
        for row, way in zip(groups[lang], tops[lang][1]):
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
            folded = leaf(row, tampered)
            for before, after in way + above:
                folded = H(before, folded, after)
            proof = H("".join(b + a for b, a in way + above))
            out.append((row["doc_id"], leaf(row), tops[lang][0], root, proof, folded, folded == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest(spark, nasty):
    import pyarrow.parquet as pq

    documents = pq.read_table(f"{nasty}/documents.parquet").to_pylist()
    got = rows(spark, "op11_merkle_manifest", nasty, *COLUMNS)
    assert got == ordered(manifest(documents))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (8, 9, 1), (64, 65, 513), tuple([1] * 9)])
def test_trees_of_all_shapes(spark, sizes):
    documents = [
        {"doc_id": i * 100 + g, "lang": None if g == 0 else f"l{g}", "source": None, "n_chars": i, "text": f"Text {i}"} for g, n in enumerate(sizes) for i in range(n)
    ]
    random.Random(3).shuffle(documents)
    df = spark.createDataFrame([tuple(d.values()) for d in documents], "doc_id long, lang string, source string, n_chars long, text string")
    shown = merkle.leaves(df, ["doc_id", "source", "lang", "n_chars", "text"], F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    found = merkle.manifest(shown, slices=3)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", F.col("folded_root") == F.col("root"))
    assert ordered(map(tuple, got.collect())) == ordered(manifest(documents))


# --- ranked search


def search(documents, items, best=10):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))

    counted = [(doc_id, i, Counter(terms(text))) for i, (doc_id, text) in enumerate(documents)]
    counted = [x for x in counted if x[2]]
    n_all, length = len(counted), sum(x[2].total() for x in counted)
    df = Counter(t for x in counted for t in x[2])
    out = []
    for item_id, text in items:
        own = set(terms(text)) & df.keys()
        weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) for t in own}
        scores = []
        for doc_id, i, tf in counted:
            m = 10 + (90 * tf.total() * n_all) // length
            score = sum(weight[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in own if t in tf)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, i, doc_id))
        out += [(item_id, rank + 1, x[-1], -x[0]) for rank, x in enumerate(sorted(scores)[:best])]
    return out


def test_search(spark, nasty, documents):
    got = rows(spark, "op12_ranked_search", nasty, "item_id", "rank", "doc_id", "score")
    assert got == ordered(search(documents, table(nasty, "benchmark", "item_id", "text")))


def test_search_with_many_equal_documents_shards_and_parts(spark, monkeypatch):
    """Small shards and parts; thousands of copies, frequent and rare terms, more items than a part takes."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    documents = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(300)], k=r.randint(1, 40)))) for i in range(3000)]
    documents += [(10_000 - i, "w1 w2 w250 Same") for i in range(2000)]
    items = [(i, " ".join(r.sample(words, 12))) for i in range(30)] + [(99, "same W250"), (100, "nowhere"), (101, None)]
    monkeypatch.setattr(ranked_search, "PART", 7)
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(3, "doc_id")
    docs = df.withColumn("row", F.monotonically_increasing_id())
    asked = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "item long, item_id long, text string").coalesce(1)
    got = ranked_search.search(docs, asked).select("item_id", "rank", "doc_id", "score")
    assert ordered(map(tuple, got.collect())) == ordered(search(documents, items))


def test_long_text_is_counted_in_stretches(spark, monkeypatch):
    text = "alpha beta gamma " * 4000 + "x" * 3000 + " alpha"
    data = pa.array([text])
    whole = ranked_search._counted(ranked_search.C.LOWER[ranked_search.C.flat(data)[0]], ranked_search.C.flat(data)[1], None)
    monkeypatch.setattr(ranked_search, "LONG_TEXT", 1000)
    n, terms, counts = ranked_search._long(ranked_search.C.LOWER[ranked_search.C.flat(data)[0]], None)
    assert n == whole[0][0] == 12002
    assert dict(zip(terms, counts)) == {"alpha": 4001, "beta": 4000, "gamma": 4000, "x" * 3000: 1}


# --- byte BPE


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(byte_bpe.model_proto(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)


def test_bpe(spark, nasty, documents, encoding):
    want = []
    for doc_id, text in documents:
        ids = encoding.encode_ordinary(text or "")
        want.append((doc_id, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text or "")))
    assert rows(spark, "op13_byte_bpe", nasty, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(want)


def test_bpe_ids_and_back(spark, documents, encoding):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(documents)], "row long, doc_id long, text string")
    ids = byte_bpe.encoded(df, RANKS, public_tokenizers.PATTERN)
    assert {r.row: r.ids for r in ids.collect()} == {i: encoding.encode_ordinary(t or "") for i, (_, t) in enumerate(documents)}
    back = byte_bpe.decoded(ids, RANKS, public_tokenizers.PATTERN)
    assert {r.row: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, (_, t) in enumerate(documents)}


def test_bpe_of_every_character(coder, encoding):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(characters), 20_000):
        text = "".join(f"a{c}1 {c} \n{c}b" for c in characters[i : i + 20_000])
        assert coder.encode(pa.array([text]))[0].tolist() == encoding.encode_ordinary(text)


def test_bpe_of_long_runs_and_stretches(coder, encoding, monkeypatch):
    text = " the cat\n" * 3000 + "a" * 5000 + " " * 5000 + "ü" * 3000 + "!" * 100
    want = encoding.encode_ordinary(text)
    assert coder.encode(pa.array([text]))[0].tolist() == want
    monkeypatch.setattr(byte_bpe, "STRETCH", 100)
    monkeypatch.setattr(byte_bpe, "KNOWN", 3)
    assert coder.encode(pa.array([text, None, text]))[0].tolist() == want + want
    ids, edges = coder.encode(pa.array([" " * 2_000_000 + "x"]))
    assert coder.decode(ids, edges)[0].as_py() == b" " * 2_000_000 + b"x"


def test_narrow_pattern_splits_like_the_whole_one():
    wide, narrow = regex.compile(public_tokenizers.PATTERN), byte_bpe.narrow_pattern(public_tokenizers.PATTERN)
    r = random.Random(1)
    for _ in range(300):
        text = "".join(chr(r.randrange(256)) for _ in range(200)) + " 's'll  \t\n x"
        assert wide.findall(text) == narrow.findall(text)
    assert byte_bpe.narrow_pattern(r"\w+|.") is None
