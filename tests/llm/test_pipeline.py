import corpus_pipeline
import pytest

from tests.llm.helpers import messy_documents, repeats, words


def _labels(spark, folder):
    spark.createDataFrame([(3, 1, 0), (4, 0, 1), (8, None, 0), (9, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_take_awkward_rows(spark, tmp_path, name, stage):
    folder = str(tmp_path)
    _labels(spark, folder)
    docs = messy_documents(spark)
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert 0 < out.count() <= docs.count()
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_decisions_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    _labels(spark, folder)
    stages = dict(corpus_pipeline.STAGES)
    docs = messy_documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in stages["quality"](spark, docs, folder).collect()}
    assert not {i for i in kept if len(words(texts[i])) < 20}
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    left = {r["doc_id"] for r in stages["ngram_join"](spark, once, folder).collect()}
    same = {}
    for i, t in sorted(texts.items(), key=lambda x: (x[0] is None, x[0])):
        if i is not None and words(t):
            same.setdefault(tuple(words(t)), i)
    assert left >= {i for i, t in texts.items() if i is not None and not words(t)}
    assert not {i for i, t in texts.items() if i is not None and words(t) and same[tuple(words(t))] != i} & left
    rows = docs.collect()
    cut = stages["substring_dedup"](spark, docs, folder)
    want = sorted(
        (repr(r["doc_id"]), kept if gone else r["text"])
        for r, (n, gone, kept) in zip(rows, repeats([r["text"] for r in rows], 35)) if n > gone
    )
    assert sorted((repr(r["doc_id"]), r["text"]) for r in cut.collect()) == want


def test_repeated_rows_and_rows_without_id_stay_once(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)

    def text(name):
        return " ".join(f"{name}{i}" for i in range(50))

    rows = [(1, text("a")), (1, text("a")), (None, text("b")), (None, text("b")), (2, text("c")), (None, text("c")), (4, text("d"))]
    # An id with two texts: one is a copy, the other is like no other.
    rows += [(3, text("e")), (7, text("e")), (7, text("f")), (None, text("g")), (5, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    once = stages["ngram_join"](spark, docs, str(tmp_path))
    want = [(1, text("a")), (2, text("c")), (3, text("e")), (4, text("d")), (5, ""), (7, text("f"))]
    want += [(None, text("b")), (None, text("g")), (None, None), (None, None)]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in once.collect()))) == sorted(map(repr, want))
    left = stages["substring_dedup"](spark, once, str(tmp_path))
    assert sorted(r["text"] for r in left.collect()) == [text(c) for c in "abcdefg"]


def test_whole_pipeline(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in rows.collect()}
    assert ids and ids <= {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
