import random

import pytest

from fleetlens.llm.queries import QUERIES
from fleetlens.llm.substring import remove_repeats, subtree_repeats

from tests.llm.helpers import messy_documents, repeats


def _by_row(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("part_windows", [200_000, 20])  # the second splits every part by longer prefixes
def test_equals_counting_every_window(spark, part_windows):
    docs = messy_documents(spark)
    got = remove_repeats(docs, length=12, part_windows=part_windows)
    rows = docs.select("doc_id", "text").collect()
    want = [(r["doc_id"], *x) for r, x in zip(rows, repeats([r["text"] for r in rows], 12))]
    assert _by_row(got, "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=repr)
    assert set(docs.columns) <= set(got.columns)


def test_periodic_and_tied_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(80)] + ["a " * 40, "a " * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = remove_repeats(docs, length=14).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in got] == repeats(texts, 14)
    for r, text in zip(got, texts):
        words = text.split()
        assert " ".join(w for i, w in enumerate(words) if not any(a <= i < b for a, b in r["removed"])) == r["kept_text"]


def test_empty_table(spark):
    empty = remove_repeats(messy_documents(spark).limit(0))
    assert empty.count() == 0 and "kept_text" in empty.columns


def test_deep_nodes_of_a_subtree():
    runs = [b"a\nb\nc\nd", b"x\nb\nc\nd", b"q\nr\ns"]
    assert subtree_repeats(runs, [1, 1, 1], 3) == [2, 2, 0]
    assert subtree_repeats(runs, [1, 1, 2], 3) == [2, 2, 1]


def test_query_equals_counting(spark, sf):
    import hashlib

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [
        (r["doc_id"], n, gone, hashlib.sha256(kept.encode()).hexdigest())
        for r, (n, gone, kept) in zip(rows, repeats([r["text"] for r in rows], 35))
    ]
    got = QUERIES["op1_substring_dedup"](spark, sf)
    assert _by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
