import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from fleetlens.llm.queries import QUERIES
from fleetlens.llm.resampling import _GAPS, cutoff_key, feature_buckets, importance_resample
from fleetlens.llm.wordbatch import slices

from tests.llm.helpers import messy_documents, messy_texts

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def features(text):
    words = TOKEN.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain(docs, target):
    """(n_features, weight, score, rank) per (doc_id, text)."""
    split = [features(t) for _, t in docs]
    s = Counter(bucket(f) for _, fs in split for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for (doc_id, _), (n, fs) in zip(docs, split):
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = [i for i, r in enumerate(rows) if r[4] >= 20]
    able.sort(key=lambda i: (-rows[i][2], docs[i][0] is None, docs[i][0] or 0))
    for rank, i in enumerate(able[: 5 * len(able) // 100], 1):
        rows[i][3] = rank
    return [tuple(r[:4]) for r in rows]


TEXTS = ["", "a", "One two THREE", "x" * 63 + " y", "w " + "z" * 64 + " q", "é" * 500 + "-Ab9 c", "a" * 70_000 + " b " + "c" * 65 + " d", "...", "ß\n\nİ K"]


def test_buckets_equal_crc_of_features():
    for part in slices(pa.array(TEXTS), gaps=_GAPS):
        got = [[] for _ in range(part.n)]
        of = part.of()
        for found, inside in feature_buckets(part):
            for i in range(len(found)):
                if inside[i]:
                    got[of[i]].append(int(found[i]))
        assert got == [[bucket(f) for f in features(t)[1]] for t in TEXTS]


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_against_plain_version(spark, few):
    docs = [(i, t) for i, t in enumerate(messy_texts() * 12)] + [(3, "twice the same row " * 9)] * 2 + [(None, "no id at all " * 9)]
    target = ["w1 w2 w3 été straße", None, "line one two", "w5 W6"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = importance_resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), few=few).collect()
    want = Counter(zip(docs, plain(docs, target)))
    assert Counter(((r["doc_id"], r["text"]), (r["n_features"], r["weight"], r["score"], r["rank"])) for r in got) == want


def test_cutoff_of_any_rank(spark):
    rows = sorted((-(i * 37 % 50), i % 7, i) for i in range(300))
    keys = spark.createDataFrame(rows, "worse long, last long, row long").repartition(5)
    for k in (1, 2, 150, 299, 300):
        assert cutoff_key(keys, k, few=3) == rows[k - 1]
    assert cutoff_key(keys, 0) is None
    with pytest.raises(ValueError):
        cutoff_key(keys, 301)


def test_awkward_tables(spark):
    docs = messy_documents(spark).selectExpr("*", "1 as _id", "2 as rest", "3 as weight", "'r' as rank", "4 as worse")
    target = spark.createDataFrame([("w1",)], "text string")
    got = importance_resample(docs, target, percent=50)
    assert got.columns == [c for c in docs.columns if c not in ("n_features", "weight", "score", "rank")] + ["n_features", "weight", "score", "rank"]
    assert got.count() == docs.count() and got.where("_id <> 1 or rest <> 2 or worse <> 4").isEmpty()
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    assert importance_resample(docs.limit(0), target).isEmpty()
    assert importance_resample(docs, target.limit(0)).count() == docs.count()


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in QUERIES["op11_importance_resampling"](spark, sf).collect()}
    assert got == {d: r for (d, _), r in zip(docs, plain(docs, target))}
