import pytest

from fleetlens.llm.licenses import SPANS, TEMPLATES, scan_licenses, train
from fleetlens.llm.queries import QUERIES

from tests.llm.helpers import messy_documents

ORDINARY = "the river runs past the old mill and nobody knows why it was ever built there at all"


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_each_family_is_found_where_it_stands(spark):
    pairs = [(f, s) for f, sentences in TEMPLATES.items() for s in sentences]
    # Identifiers of a few words stand on lines of their own.
    texts = [f"{ORDINARY}\n{s} {ORDINARY if len(s.split()) > 3 else ''}\n{ORDINARY}" for _, s in pairs] + [ORDINARY, f"{ORDINARY} license of the river"]
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in scan_licenses(_docs(spark, texts)).collect()}
    assert got == {(i, 1): f for i, (f, _) in enumerate(pairs)}


def test_ordinary_and_shuffled_words_are_unknown(spark):
    texts = [ORDINARY, "version public general", "software work license under", "of the and to in"] * 3
    assert scan_licenses(_docs(spark, texts)).isEmpty()


def test_a_declaration_deep_in_a_long_paragraph(spark):
    text = f"{ORDINARY} " * 60 + TEMPLATES["mit"][0] + f" {ORDINARY}" * 60
    row = scan_licenses(_docs(spark, [text])).first()
    assert row["family"] == "mit" and row["n_words"] <= max(s for s, _ in SPANS)


def test_awkward_rows(spark):
    docs = messy_documents(spark)
    assert scan_licenses(docs).count() == 0
    assert scan_licenses(docs.limit(0)).count() == 0
    twice = _docs(spark, [TEMPLATES["gpl"][0]]).unionAll(_docs(spark, [TEMPLATES["gpl"][0], None]))
    assert scan_licenses(twice).count() == 2


def test_held_out_accuracy():
    from fleetlens.llm.licenses import _template_pairs, scan_paragraphs
    from fleetlens.llm.wordbatch import PUNCTUATION, words_of
    import numpy as np

    model = train([ORDINARY] * 50 + ["another plain sentence about nothing in particular"] * 50)
    sentences = [(f, s.replace(",", " ,").upper().lower()) for f, v in TEMPLATES.items() for s in v]
    data = [s.encode() for _, s in sentences]
    part = words_of(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 0, PUNCTUATION)
    found = {t[0]: t[1] for t in scan_paragraphs(part, model, _template_pairs())}
    assert sum(found.get(i) == f for i, (f, _) in enumerate(sentences)) / len(sentences) >= 0.95


@pytest.mark.parametrize("name", ["op3_license_scans"])
def test_query_finds_every_declared_line(spark, sf, name):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {
        (r["doc_id"], i) for r in rows for i, line in enumerate((r["text"] or "").split("\n"))
        if any(s in line for v in TEMPLATES.values() for s in v)
    }
    got = {(r["doc_id"], r["paragraph"]) for r in QUERIES[name](spark, sf).collect()}
    assert want <= got
