"""A corpus pipeline over ``documents``: every stage is written as Parquet and read back for the next.

Each stage takes ``(spark, docs, sf_dir)`` and works on every document that its predecessor kept.  All
but the last return the columns of the documents, whatever those are; only ``doc_id``, ``text``,
``lang``, ``source`` and ``n_chars`` have a meaning here, and only ``text`` and ``n_chars`` change.
Null and empty texts fail the quality rules.  An empty table passes through all stages empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.ngramjoin import near_duplicates
from fleetlens.llm.packing import pack_documents
from fleetlens.llm.quality import quality_rules
from fleetlens.llm.queries import TOKENIZER
from fleetlens.llm.shipping import ship
from fleetlens.llm.storage import stored
from fleetlens.llm.substring import remove_repeats
from fleetlens.llm.toxicity import score_toxicity


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _apart(docs: DataFrame, *named: str) -> DataFrame:
    """``text``, the named columns, and everything but the text as one column that clashes with none."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(rest.alias("_rest"), "text", *named)


def _together(frame: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    at = {"text": F.col("text"), **changed}
    return frame.select(*[at.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return _together(quality_rules(_apart(docs, "lang", "source")).where("kept"), docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _together(score_toxicity(_apart(docs, "doc_id"), labels).where("predicted = 0"), docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest id.

    Rows are compared one by one, whatever their ids: of rows that repeat an id, or have none, all but
    one go if their texts are alike, and each stays if it is like no other.  An id comes before none.
    """
    ship(spark)
    # Numbers of rows hold only as long as the rows are not read anew, so they are written down.
    numbered = stored(_apart(docs, "doc_id").withColumn("_row", F.monotonically_increasing_id()), "join-rows")
    alike = near_duplicates(numbered.select("_row", "text"), "_row").where("n_links > 0").select("_row", "component_id")
    alike = stored(alike.join(numbered.select("_row", "doc_id"), "_row"), "join-alike")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = alike.groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    gone = alike.join(first, "_row", "left_anti").select("_row")
    return _together(numbered.join(gone, "_row", "left_anti"), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go; documents without any keep their text as it is, emptied ones go."""
    ship(spark)
    cut = remove_repeats(_apart(docs)).where("n_words > n_removed")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("_rest.n_chars"))
    return _together(cut, docs, text=text, n_chars=length)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in training sequences."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Models and packings are not expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on everything that its predecessor kept."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
