"""Quality rules: base rules per text, then robust multivariate outliers per language and source.

Everything is DataFrame and SQL functions.  The statistics of each text are computed within its row.
A minimum-covariance-determinant estimate per (language, source) is refined by concentration steps:
the distances of the current estimate select the closest share of the group, whose mean and
covariance are the next estimate.  The share is cut by a histogram of distances in fixed steps, so a
group of any size is only ever summed, never collected or sorted.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import stored

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

SHARE = 0.75  #: of a group, that its estimate rests on
STEPS = 3  #: concentration steps
MIN_GROUP = 200  #: smaller groups use the estimate of their language, then of all rows
TAIL = 0.001  #: of normally distributed texts, that the cutoff rejects
BINS_PER_OCTAVE = 16

#: Each statistic on the scale it is compared on, and the least deviation that rejects a text alone.
#: A statistic that is constant in the core of a group would otherwise reject any other value.  A
#: factor of 1.6 in word length, 3.6 symbols per 100 characters, 30 percent of the lines, and half
#: of the repeated words that the base rule lets pass.
LEAST = {"word_length": math.log(1.6), "symbols": math.sqrt(0.036), "dup_lines": math.sqrt(0.3), "repeats": math.sqrt(MAX_REPEAT_PERCENT / 200)}


def _chi_square(x: float, degrees: int) -> float:
    """Share of a chi-square distribution with an even number of degrees up to ``x``."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def _chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle, degrees) < share else (low, middle)
    return high


#: Squared Mahalanobis distance beyond which a text is rejected.
CUTOFF = _chi_square_quantile(1 - TAIL, len(LEAST))
#: What the covariance of the closest share of a normal distribution is short of the whole one's.
CONSISTENCY = SHARE / _chi_square(_chi_square_quantile(SHARE, len(LEAST)), len(LEAST) + 2)
#: Standard deviations added to those of the core, from the least deviations.
FLOORS = {name: least / math.sqrt(CUTOFF) for name, least in LEAST.items()}


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, within one row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _repeated_words(w: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur at least twice, the first one included."""

    def covered(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            hit = F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        ((j > 0) & (x["h"] == F.get(s, j - 1)["h"])) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            # Each start adds its window up to the next start.
            return F.aggregate(
                F.array_sort(hit),
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                lambda a, i: F.struct(
                    (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")
                ),
                lambda a: a["n"].cast("long"),
            )

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
            _let(ordered, starts)
        )

    grams = F.transform(
        F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW))
    )
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(grams, covered))


def _text_facts(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(F.split(body, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _let(lines, F.size).cast("long").alias("n_lines"),
            _repeated_words(w).alias("n_repeat_words"),
        ),
    )


def text_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed``.

    Null counts as empty.  Columns of those names are replaced.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    kept = [c for c in documents.columns if c not in own and c != "base_failed"]
    facts = documents.select(*[F.col(f"`{c}`") for c in kept], _text_facts(F.col(text)).alias("_facts"))
    failed = (F.col("_facts.n_words") < MIN_WORDS) | (
        100 * F.col("_facts.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_facts.n_words")
    )
    return facts.select(*kept, *[F.col(f"_facts.{c}") for c in own], failed.alias("base_failed"))


def _scaled() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


NAMES = list(FLOORS)
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _moments() -> list[Column]:
    x = [F.col(n) for n in NAMES]
    return [F.count("*").alias("m"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)]] + [
        F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS
    ]


def _estimate(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and lower Cholesky factor of the consistent covariance from sums, with the floors on the diagonal."""
    mean = {i: F.col(f"s{i}") / F.col("m") for i in range(P)}
    out = sums.select(
        *keys, "m", *[mean[i].alias(f"mu{i}") for i in range(P)],
        *[
            (CONSISTENCY * (F.col(f"q{i}{j}") / F.col("m") - mean[i] * mean[j]) + (FLOORS[NAMES[i]] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
            for i, j in PAIRS
        ],
    )
    # Column by column; each factor is a column of its own, so the next ones can refer to it.
    for j in range(P):
        inner = reduce(lambda a, b: a + b, [F.col(f"l{j}{k}") ** 2 for k in range(j)], F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner, F.lit(FLOORS[NAMES[j]] ** 2 / 4))))
        below = {}
        for i in range(j + 1, P):
            inner = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
            below[f"l{i}{j}"] = (F.col(f"c{i}{j}") - inner) / F.col(f"l{j}{j}")
        out = out.withColumns(below) if below else out
    return out.select(*keys, "m", *[f"mu{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def _distance(rows: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        done = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)], F.lit(0.0))
        rows = rows.withColumn(f"z{i}", (F.col(NAMES[i]) - F.col(f"mu{i}") - done) / F.col(f"l{i}{i}"))
    total = reduce(lambda a, b: a + b, [F.col(f"z{i}") ** 2 for i in range(P)])
    return rows.withColumn("d2", total)


def _binned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * BINS_PER_OCTAVE).cast("int"))


def _closest(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Rows whose distance step holds the closest ``share`` of their group (ties included)."""
    binned = _binned(rows)
    counts = binned.groupBy(*keys, "bin").count()
    running = Window.partitionBy(*keys).orderBy("bin")
    limits = (
        counts.withColumn("before", F.sum("count").over(running) - F.col("count"))
        .withColumn("all", F.sum("count").over(Window.partitionBy(*keys)))
        .where(F.col("before") < F.ceil(F.col("all") * share))
        .groupBy(*keys)
        .agg(F.max("bin").alias("limit"))
    )
    return binned.join(limits, keys).where("bin <= limit")


def mcd(rows: DataFrame, keys: list[str], purpose: str, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Mean and Cholesky factor per group of ``keys``, from the closest ``share`` of its rows.

    The start is the group's median with the floors as spread, so junk has no part in it.
    """
    start = rows.groupBy(*keys).agg(
        F.count("*").alias("m"), *[F.percentile_approx(n, 0.5, 1000).alias(f"mu{i}") for i, n in enumerate(NAMES)]
    )
    estimate = start.select(
        *keys, "m", *[f"mu{i}" for i in range(P)],
        *[F.lit(FLOORS[NAMES[i]] if i == j else 0.0).alias(f"l{i}{j}") for i, j in PAIRS],
    )
    for step in range(steps):
        near = _closest(_distance(rows.join(estimate.drop("m"), keys)), keys, share)
        estimate = stored(_estimate(near.groupBy(*keys).agg(*_moments()), keys), f"{purpose}-{step}")
    return estimate


FIELDS = [f"mu{i}" for i in range(P)] + [f"l{i}{j}" for i, j in PAIRS]


def _literals(estimate: Row) -> dict[str, Column]:
    return {f: F.lit(estimate[f]).cast("double") for f in FIELDS}


def mcd_of_all(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> Row | None:
    """The same over all rows; its few numbers pass through the driver and need no join.

    None for an empty table.  The histogram has a row per step of the distance, whatever the table.
    """
    start = rows.agg(F.count("*").alias("m"), *[F.percentile_approx(n, 0.5, 1000).alias(f"mu{i}") for i, n in enumerate(NAMES)]).first()
    if not start["m"]:
        return None
    spread = {f"l{i}{j}": FLOORS[NAMES[i]] if i == j else 0.0 for i, j in PAIRS}
    estimate = Row(**(start.asDict() | spread))
    for _ in range(steps):
        binned = _binned(_distance(rows.withColumns(_literals(estimate))))
        seen, limit, enough = 0, None, math.ceil(start["m"] * share)
        for step, n in sorted(binned.groupBy("bin").count().collect()):
            if seen < enough:
                limit = step
            seen += n
        estimate = _estimate(binned.where(F.col("bin") <= limit).agg(*_moments()), []).first()
    return estimate


def quality_rules(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    cutoff: float = CUTOFF,
    min_group: int = MIN_GROUP,
    keep_text: bool = True,
) -> DataFrame:
    """Input rows with the statistics, ``base_failed``, ``distance`` and ``kept``.

    A text fails if it has under 20 words or if repeated windows hold over 30 percent of its words;
    of the others, those with a squared robust distance over ``cutoff`` from their (language, source)
    are rejected.  Only texts that pass the base rules take part in the estimates.  A null language
    or source is a group of its own.  Groups of fewer than ``min_group`` texts are judged by their
    language, languages of fewer by all rows; with fewer than that in all, only the base rules hold.
    Repeated rows count and are judged one by one; an empty table gives an empty result.  Columns
    named like the added ones are replaced.  ``keep_text=False`` leaves the text column out.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", *NAMES, "distance", "kept")
    kept = [c for c in documents.columns if c not in own and (keep_text or c != text)]
    # Columns of any name travel in a struct; it needs a field, also where no other column is kept.
    filler = "_" * (1 + max(map(len, kept), default=0))
    others = [F.col(f"`{c}`") for c in kept if c != text]
    facts = text_statistics(
        documents.select(
            F.struct(F.lit(0).alias(filler), *others).alias("rest"), F.col(f"`{text}`").alias("text"),
            F.coalesce(F.concat(F.lit("="), F.col(f"`{lang}`")), F.lit("")).alias("lang"),
            F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit("")).alias("source"),
        )
    )
    # The expensive statistics are computed once; all that follows reads this table.
    rows = stored(
        facts.select(*[c for c in facts.columns if keep_text or c != "text"], *[value.alias(name) for name, value in _scaled().items()]),
        "quality-rows",
    )
    passed = rows.where(~F.col("base_failed")).select("lang", "source", *NAMES)
    judged, estimates = rows, []
    # The share of a group is what the estimate rests on.
    for level, keys in enumerate((["lang", "source"], ["lang"])):
        found = mcd(passed, keys, f"mcd-{level}").where(F.col("m") >= min_group * SHARE)
        judged = judged.join(found.select(*keys, F.struct(*FIELDS).alias(f"_est{level}")), keys, "left")
        estimates.append(F.col(f"_est{level}"))
    whole = mcd_of_all(passed)
    if whole is not None and whole["m"] >= min_group * SHARE:
        estimates.append(F.struct(*[value.alias(f) for f, value in _literals(whole).items()]))
    judged = _distance(judged.withColumn("_est", F.coalesce(*estimates)).select("*", "_est.*"))
    return judged.select(
        *[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in kept],
        *own[:6], "base_failed", F.col("d2").alias("distance"),
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"),
    )
