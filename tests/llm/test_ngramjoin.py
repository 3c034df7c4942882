import random

from fleetlens.llm.ngramjoin import near_duplicates, prefix_length
from fleetlens.llm.queries import QUERIES

from tests.llm.helpers import jaccard_links, messy_documents, smallest_reachable


def _compare(docs, **options):
    """Documents with distinct keys against all pairs."""
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    links = jaccard_links([r["text"] for r in rows])
    reach = smallest_reachable(len(rows), links)
    got = near_duplicates(docs, **options).orderBy("doc_id").collect()
    assert [r["n_links"] for r in got] == [len(links[i]) for i in range(len(rows))]
    assert [r["component_id"] for r in got] == [rows[i]["doc_id"] for i in reach]
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _compare(docs)
    _compare(docs, block=7)  # every cluster in many blocks


def test_awkward_rows(spark):
    docs = messy_documents(spark)
    distinct = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    _compare(distinct)
    got = near_duplicates(docs)
    assert got.count() == docs.count()
    assert not got.where("doc_id is null").first()["kept"]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_prefix_is_shortened_to_the_recall():
    length = prefix_length(0.8, 24, 8, 0.999)
    assert 1 - (1 - 0.8**length) ** 24 >= 0.999 > 1 - (1 - 0.8 ** (length + 1)) ** 24


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    links = jaccard_links([r["text"] for r in rows])
    got = QUERIES["op5_ngram_jaccard_join"](spark, sf).orderBy("doc_id").collect()
    assert [r["n_links"] for r in got] == [len(links[i]) for i in range(len(rows))]
