import math
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from fleetlens.llm.queries import QUERIES
from fleetlens.llm.toxicity import FIRM, discount, fit_models, score_toxicity, text_ratios

from tests.llm.helpers import messy_documents

BAD = ["grumbus", "flarnog", "wretchit"]


def _corpus(spark, n=900):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 400))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "."]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _corpus(spark)
    rows = score_toxicity(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) >= 0.98


def test_held_out_labels_are_never_used(spark):
    docs, labels = _corpus(spark, 200)
    flipped = labels.selectExpr(
        "doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic"
    )
    a = {r["doc_id"]: r["score"] for r in score_toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in score_toxicity(docs, flipped).collect()}
    assert a == pytest.approx(b)


def test_awkward_rows(spark):
    docs = messy_documents(spark)
    labels = spark.createDataFrame(
        [(0, 1), (3, 0), (4, None), (None, 1), (7, 1), (7, 0), (8, 0), (9, 0), (12, 1), (99, 1)], "doc_id long, toxic int"
    )
    for table in (labels, labels.where("toxic = 1"), labels.limit(0)):
        scored = score_toxicity(docs, table)
        assert scored.count() == docs.count()
        assert scored.where("score is null or held_out is null or predicted is null or isnan(score)").isEmpty()
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_copies_do_not_make_rare_words_toxic(spark):
    docs, labels = _corpus(spark, 300)
    copy = "a grumbus remark about zanzibarley gardens " + " ".join(f"path{i}" for i in range(40))
    other = "we grow zanzibarley along the path10 and " + " ".join(f"field{i}" for i in range(40))
    more = spark.createDataFrame([(1000 + i, copy) for i in range(40)] + [(2000, other)], "doc_id long, text string")
    marked = spark.createDataFrame([(1000 + i, 1) for i in range(40)], "doc_id long, toxic int")
    scored = score_toxicity(docs.unionByName(more), labels.unionByName(marked))
    assert scored.where("doc_id >= 1000 and doc_id < 2000 and predicted = 0").isEmpty()
    assert scored.where("doc_id = 2000").first()["predicted"] == 0


def _plain_ratios(taught, every, texts):
    """The four ratios of each text by dictionaries, straight from the formula."""
    pairs = {0: Counter(), 1: Counter()}
    for words, y in taught:
        for v, w in zip(["", *words], words):
            pairs[y][v, w] += 1
    corpus = Counter(w for words in every for w in words)
    size = sum(corpus.values())
    contexts, kinds, after = ({y: defaultdict(int) for y in pairs} for _ in range(3))
    for y, counted in pairs.items():
        for (v, w), n in counted.items():
            contexts[y][w] += 1
            kinds[y][v] += 1
            after[y][v] += n

    def taken(counts):
        return discount(sum(n == 1 for n in counts), sum(n == 2 for n in counts))

    of_words = {y: taken(contexts[y].values()) for y in pairs}
    of_pairs = {y: taken(pairs[1].values()) for y in pairs}

    def word(y, w):
        total = sum(contexts[y].values())
        seen = len([x for x in contexts[y].values() if x])
        return max(contexts[y][w] - of_words[y], 0) / total + of_words[y] * seen / total * corpus[w] / size

    def heavy(y, w):
        total, free = sum(contexts[y].values()), sum(min(n, FIRM) for n in contexts[y].values())
        return max(contexts[y][w] - FIRM, 0) / total + free / total * corpus[w] / size

    def pair(y, v, w):
        if not after[y][v]:
            return word(y, w)
        return max(pairs[y][v, w] - of_pairs[y], 0) / after[y][v] + of_pairs[y] * kinds[y][v] / after[y][v] * word(y, w)

    vocabulary = {w for words, _ in taught for w in words}
    out = []
    for words in texts:
        ratio, plain, firm = [], [], []
        for v, w in zip(["", *words], words):
            plain.append(math.log(word(1, w) / word(0, w)) if w in vocabulary else 0.0)
            firm.append(math.log(heavy(1, w) / heavy(0, w)) if max(contexts[0][w], contexts[1][w]) > FIRM else 0.0)
            ratio.append(math.log(pair(1, v, w) / pair(0, v, w)) if (v, w) in pairs[1] else plain[-1])
        known = sum(w in vocabulary for w in words)
        best = [
            max([sum(x[i : i + 3]) / 3 for i in range(len(x) - 2)] or [sum(x) / max(1, len(x))]) for x in (ratio, plain, firm)
        ]
        out.append((sum(ratio) / max(1, known), *best))
    return out


def test_ratios_equal_plain_kneser_ney(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [[words[int(rng.random() ** 2 * 40)] for _ in range(rng.randint(0, 25))] for _ in range(60)]
    taught = [(t, int(i % 3 == 0)) for i, t in enumerate(texts[:40])]
    rest = [int(i % 4 != 0) for i in range(40)]
    more = texts[40:] + [["unseen", "w1", "never"], [], ["w2"], ["w3", "w4"]]
    labelled = spark.createDataFrame([(" ".join(t), y, m) for (t, y), m in zip(taught, rest)], "_text string, _label int, _rest int")
    docs = spark.createDataFrame([(" ".join(t),) for t in texts + more], "text string")
    paths = fit_models(labelled, docs, "text")
    column = pa.array([" ".join(t) for t in texts + more])
    for model, known in (("a", taught), ("b", [x for x, m in zip(taught, rest) if m])):
        want = _plain_ratios(known, texts + more, texts + more)
        got = text_ratios(column, *paths, model)
        for i in (0, 1, 2, 3) if model == "a" else (1, 2, 3):
            assert got[i] == pytest.approx([w[i] for w in want], abs=1e-5)


def test_words_that_toxic_texts_show_once_or_twice(spark):
    rng = random.Random(8)
    vocabulary = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(1200):
        words = [vocabulary[int(rng.random() ** 2 * 500)] for _ in range(rng.randint(20, 60))]
        toxic = i % 10 == 0
        if toxic:  # sixty words, each in two texts
            words.insert(rng.randrange(len(words)), f"vile{i // 10 % 60}")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in score_toxicity(docs, labels).collect()}
    learnt = {i // 10 % 60 for i in range(0, 1200, 10) if not rows[i]["held_out"]}
    unseen = [i for i in range(0, 1200, 10) if rows[i]["held_out"] and i // 10 % 60 in learnt]
    assert len(unseen) > 10
    assert sum(rows[i]["predicted"] for i in unseen) / len(unseen) >= 0.9
    clean = [i for i in rows if i % 10]
    assert sum(rows[i]["predicted"] for i in clean) / len(clean) <= 0.02


def test_other_columns_may_have_any_name(spark):
    docs, labels = _corpus(spark, 60)
    names = ["_raw", "_key", "_text", "_label", "_hash", "w", "a.b", "mean"]
    more = docs.select("*", *[docs["doc_id"].alias(c) for c in names])
    scored = score_toxicity(more, labels)
    assert scored.columns == [*more.columns, "held_out", "score", "predicted"]
    assert all(r[c] == r["doc_id"] for r in scored.collect() for c in names)


def test_query(spark, sf):
    rows = QUERIES["op10_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in rows)
