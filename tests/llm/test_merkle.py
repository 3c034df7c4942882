import hashlib
import zlib
from collections import Counter, defaultdict

from fleetlens.llm import merkle
from fleetlens.llm.merkle import build_block, descend, levels_of, merkle_manifest, proof_digest
from fleetlens.llm.queries import QUERIES
from pyspark.sql import functions as F

from tests.llm.helpers import messy_documents

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Root, and per leaf the (place, siblings) of every level, upwards."""
    paths, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, above_held = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for j in range(len(run)):
                for leaf in held[i + j]:
                    paths[leaf].append((j, run[:j] + run[j + 1 :]))
            above.append(H(*run))
            above_held.append([x for h in held[i : i + 3] for x in h])
        nodes, held = above, above_held
    return nodes[0], paths


def plain(rows):
    """Counter of result rows of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in sources}
    root, upper = tree([trees[s][0] for s in sources])
    out = Counter()
    for s, above in zip(sources, upper):
        for (_, _, leaf, row), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf_of((*row[:4], text))
            for place, others in path + above:
                node = H(*others[:place], node, *others[place:])
            proof = H(*[x for _, others in path + above for x in others])
            out[row[0], leaf, trees[s][0], root, proof, node, node == root] += 1
    return out


def run(frame):
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle_manifest(frame, FIELDS, {"text": F.when(picked, F.translate("text", "\n", "")).otherwise(F.col("text"))})
    return Counter(
        tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")), "folded_root", "verified").collect()
    )


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_blocks():
    for n in (1, 2, 3, 4, 9, 10, 80, 243):
        nodes = [H(str(i)) for i in range(n)]
        top, records = build_block(nodes, levels_of(n))
        want, paths = tree(nodes)
        assert top == want
        for i in range(n):
            assert descend(top, records, i, levels_of(n)) == (nodes[i], paths[i][::-1])


def test_against_plain_version(spark):
    rows = [(i, None if i % 3 == 0 else f"s{i % 7 if i % 2 else 1}", "en", i, f"text {i}\n" if i % 4 else None) for i in range(1100)]
    rows += [(None, "s1", None, None, "\n"), (5, "s1", "en", 1, "")] + [(7, "é", "en", 2, "x\ny")] * 3 + [(9, "", "", 0, "-")]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_many_sources_and_one_leaf(spark):
    rows = [(i, f"host{i}", None, i, None) for i in range(300)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert run(spark.createDataFrame(rows[:1], SCHEMA)) == plain(rows[:1])
    assert run(spark.createDataFrame(rows[:0], SCHEMA)) == Counter()


def test_awkward_rows(spark):
    docs = messy_documents(spark).selectExpr("*", "1 as tree", "2 as rank", "3 as digest", "4 as load", "'x' as base")
    assert run(docs) == plain([tuple(r) for r in docs.select(*FIELDS).collect()])


def test_wrong_records_are_noticed():
    top, records = build_block(["a", "b", "c", "d"], 2)
    node, path = descend(top, records, 3, 2)
    assert node == "d" and path == [(1, [H("a", "b", "c")]), (0, [])]
    assert merkle.levels_of(4) == 2


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    got = QUERIES["op13_merkle_manifest"](spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows)
