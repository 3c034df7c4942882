from collections import Counter

from pyspark.sql import functions as F

from fleetlens.llm.quality import quality_rules, text_statistics
from fleetlens.llm.queries import QUERIES

from tests.llm.helpers import messy_documents, messy_texts, words


def facts(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_plain_counts(spark):
    texts = [*messy_texts(), "a#b *|<>&%$ x\x0by\x0cz\r\n   ", "é" * 30 + " 👍", "\n\n", "ab " * 8, "a b c d e f g h " * 2 + "x"]
    rows = text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(r[n] for n in names) for r in rows] == [facts(t) for t in texts]
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])


def _corpus(spark, junk=12):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(600):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(40, 300)))
        if i < junk:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 2}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_clean_texts_stay(spark):
    judged = quality_rules(_corpus(spark)).collect()
    assert {r["doc_id"] for r in judged if not r["kept"]} == set(range(12))


def test_each_statistic_alone_rejects(spark):
    rows = [(r["doc_id"], r["text"]) for r in _corpus(spark, junk=0).collect()]
    plain = [t.split() for _, t in rows[:4]]
    planted = {
        "word_length": " ".join(w * 4 for w in plain[0]),
        "symbols": " ".join(w + ("#" if i % 2 else "") for i, w in enumerate(plain[1])),
        # A list whose lines nearly all occur twice, all shorter than a window of repeated words.
        "dup_lines": "\n".join(" ".join(plain[2][i : i + 3]) for k in range(0, 30, 6) for _ in range(2) for i in (k, k + 3)),
        "repeats": " ".join(plain[3][:40] + plain[1][:12] + plain[3][:8]),
    }
    texts = rows + [(1000 + i, t) for i, t in enumerate(planted.values())]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string")
    judged = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for i, name in enumerate(planted):
        assert not judged[1000 + i]["base_failed"], name
        assert not judged[1000 + i]["kept"], (name, judged[1000 + i]["distance"])


def test_awkward_rows_have_results(spark):
    docs = messy_documents(spark)
    judged = quality_rules(docs)
    assert judged.count() == docs.count()
    assert judged.where("kept is null or base_failed is null").isEmpty()
    assert judged.where("text is null or trim(text) = ''").where("kept").isEmpty()
    assert quality_rules(docs.limit(0)).count() == 0


def test_columns_of_any_name_keep_their_values(spark):
    plain = _corpus(spark)
    named = ["mu0", "_est0", "_est", "_facts", "d2", "z0", "_any", "l00", "m", "bin", "rest", "_", "__"]
    judged = quality_rules(plain.selectExpr("*", *[f"'{n}!' as {n}" for n in named], "'x' as kept", "7 as n_words"))
    assert len(set(judged.columns)) == len(judged.columns)
    assert all(r[n] == f"{n}!" for r in judged.collect() for n in named)
    assert {r["doc_id"]: r["kept"] for r in judged.collect()} == {r["doc_id"]: r["kept"] for r in quality_rules(plain).collect()}


def test_all_rows_are_judged_by_one_estimate_without_a_join(spark):
    rows = [(i, r["text"], f"l{i % 40}", None) for i, r in enumerate(_corpus(spark).collect())]
    judged = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r["doc_id"] for r in judged.collect() if not r["kept"]} == set(range(12))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_main_path_is_native(spark, sf):
    plan = QUERIES["op2_quality_rules"](spark, sf)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert plan.count() == docs.count()
    assert plan.agg(F.countDistinct("doc_id")).first()[0] == docs.count()
