import numpy as np

from fleetlens.llm.components import connected_components
from fleetlens.llm.embeddings import near_duplicate_vectors
from fleetlens.llm.queries import QUERIES

from tests.llm.helpers import smallest_reachable

NAN, INF = float("nan"), float("inf")


def _expected(vectors):
    links = {i: set() for i in range(len(vectors))}
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                links[i].add(j)
                links[j].add(i)
    return [len(links[i]) for i in range(len(vectors))], smallest_reachable(len(vectors), links)


def test_against_all_pairs_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(60):
        base = rng.normal(size=12)
        vectors += [(base + rng.normal(scale=s, size=12)).tolist() for s in rng.uniform(0, 0.4, rng.integers(1, 9))]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[1]]] + [[1.0, 0.0]] * 2
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    links, component = _expected(vectors)
    for options in ({}, {"hosts": 11, "members": 17}):
        got = near_duplicate_vectors(table, **options).orderBy("vec_id").collect()
        assert [r["n_links"] for r in got] == links
        assert [r["component_id"] for r in got] == component
        assert [r["kept"] for r in got] == [i == c for i, c in enumerate(component)]


def test_unusable_vectors_and_rows(spark):
    rows = [
        (1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "b"), (3, None, "c"), (4, [], "d"), (5, [0.0, 0.0], "e"),
        (6, [NAN, 1.0], "f"), (7, [INF, 1.0], "g"), (8, [None, 1.0], "h"), (None, [1.0, 0.0], "i"), (2, [1.0, 0.01], "j"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicate_vectors(table).collect()), key=repr)
    want = [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), *[(i, 0, i, True) for i in range(3, 9)], (None, 0, None, False)]
    assert got == sorted(want, key=repr)
    assert near_duplicate_vectors(table.limit(0)).count() == 0


def test_components_of_chains_and_repeats(spark):
    edges = [(i + 1, i) for i in range(100, 160)] + [(5, 3), (3, 5), (9, 9), (None, 1), (3, 1)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 1, 3: 1, 1: 1}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    links, component = _expected([r["embedding"] for r in rows])
    got = QUERIES["op6_embedding_near_dedup"](spark, sf).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == links
    assert [r["component_id"] for r in got] == [rows[i]["vec_id"] for i in component]
