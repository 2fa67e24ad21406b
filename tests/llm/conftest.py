"""Small tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the of and to in is was that for it on as with his at by from had not are".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def nasty_documents():
    r = random.Random(7)
    passage = sentence(r, 40)
    long_line = "  A line that many documents share, written at some length.  "
    rows = []
    for i in range(30):
        rows.append((i, f"{sentence(r, r.randint(1, 60))}\n{long_line}\n{sentence(r, 5)}"))
    rows += [(40 + i, sentence(r, 10) + " " + passage + " " + sentence(r, 10)) for i in range(5)]
    base = sentence(r, 80)
    rows += [(50, base), (51, base), (51, base), (52, base.replace("the", "a", 1))]
    rows += [(60, None), (61, ""), (62, "   \n\n \t"), (None, passage), (None, None), (None, long_line)]
    rows += [(63, "Ünï cödé Ω " * 30), (64, "x" * 5000), (65, "ab" * 400), (66, "\x00" * 300), (67, "12 34 !!"), (68, "a\\b<s>[INST]")]
    rows += [(70, "\n".join([sentence(r, 12)] * 6)), (71, "THE QUICK!! " * 40), (72, "one | two | three | " * 20)]
    rows += [(80, " ".join(sentence(r, 20) for _ in range(300)))]
    return rows


def write(folder, name, columns):
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def write_tables(folder, documents, items, pages, labels, turns):
    def column(rows, i, kind):
        return pa.array([x[i] for x in rows], kind)

    text, whole = pa.string(), pa.int64()
    write(folder, "documents", {
        "doc_id": column(documents, 0, whole), "text": column(documents, 1, text),
        "lang": pa.array([None if i % 9 == 0 else ("en", "de")[i % 2] for i in range(len(documents))], text),
        "source": pa.array(["s"] * len(documents), text), "n_chars": pa.array([len(x[1] or "") for x in documents], whole),
        "row": pa.array(["clash"] * len(documents), text), "key": pa.array([1.5] * len(documents)), "bits": pa.array([True] * len(documents)),
    })
    write(folder, "benchmark", {"item_id": column(items, 0, whole), "text": column(items, 1, text), "words": pa.array([0] * len(items), whole)})
    write(folder, "pages", {
        "page_id": column(pages, 0, whole), "url": column(pages, 1, text), "html": column(pages, 2, text),
        "payload_digest": pa.array(["no"] * len(pages), text),
    })
    write(folder, "labels", {
        "doc_id": column(labels, 0, whole), "quality": pa.array([x[1] for x in labels], pa.int32()),
        "toxic": pa.array([0] * len(labels), pa.int32()), "score": pa.array(["x"] * len(labels), text),
    })
    write(folder, "conversations", {
        "conv_id": column(turns, 0, whole), "turn": column(turns, 1, whole), "role": column(turns, 2, text),
        "text": column(turns, 3, text), "example": pa.array(["no"] * len(turns), text),
    })
    return str(folder)


@pytest.fixture(scope="session")
def nasty(tmp_path_factory):
    documents = nasty_documents()
    passage = documents[32][1]
    items = [(1, " ".join(passage.split()[12:30])), (2, "the of"), (2, "the of"), (11, "THE, of!"), (3, None), (4, ""), (None, "and to in"), (5, "!!!")]
    items += [(6, " ".join(documents[-1][1].split()[100:125]))]
    big = "p" * 150
    pages = [(1, "http://a/ b", big), (2, "http://b", big), (2, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "u\r\n", None)]
    pages += [(6, "u", ""), (None, "u", big), (None, "u", "q" * 200), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9), (0, "é", "ü" * 60), (8, "u", "ü" * 60)]
    labels = [(x[0], 0 if x[0] in (70, 71, 72, 62) else 1) for x in documents] + [(9999, 1), (1, None), (2, 1)]
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b </s><s> [INST]\n"), (1, 2, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    turns += [(3, None, None, "x"), (3, 5, "as\nsist\\ant", "<</s>s>"), (None, 1, "assistant", "n"), (None, 0, "system", "ü" * 9), (4, 1, "user", "only")]
    turns += [(5, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(50)]
    return write_tables(tmp_path_factory.mktemp("nasty"), documents, items, pages, labels, turns)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [], [], [], [], [])


@pytest.fixture(scope="session")
def documents():
    return nasty_documents()
