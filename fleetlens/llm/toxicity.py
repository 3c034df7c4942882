"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of word pairs, learnt from its labelled texts.  A word
after its previous word has its pair count less an absolute discount; what the discount takes goes to
the word's continuation count (in how many different contexts the class shows it), less a discount
too; what that takes goes to a backoff that both classes share, the word's count over all documents.
Discounts are those of Ney, Essen and Kneser, n1 / (n1 + 2 n2) from the numbers of counts of one and two;
that of pairs is taken from the toxic texts, whose pairs are all counted.
So a word that a class shows once still speaks, as loudly as it is rare elsewhere.  A word
that no labelled text holds has the backoff alone in both models and is left out of the comparison.
A pair that no toxic text holds is compared as a word, in both models.

A text has four length-normalised log-likelihood ratios: of all its words, and the highest of an
expression of three adjacent words, by the models of pairs, by their continuation level alone, and by that level
under a discount of three contexts, where words with no more in either class say nothing.  A few words
make a long text toxic, and how much a pair or a word seen once is worth differs from corpus to corpus;
a logistic curve weighs the four and turns them into a probability.  It is fitted on a fifth of the labelled texts, scored by models of the other four
fifths, so that no text speaks for itself; the scores come from models of all of them.

The models are tables in the shared folder, written by Spark and read by the tasks; the driver sees
totals and the binned ratios of the curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.memory import sparing
from fleetlens.llm.storage import release, shared_folder, stored
from fleetlens.llm.wordbatch import PUNCTUATION, Words, mix, slices

DISCOUNT = 0.75  #: taken from every count of a level without counts of one or two
EXPRESSION = 3  #: adjacent words whose likelihoods are averaged
MAX_LABELLED = 200_000  #: labelled rows that the class models and the curve are fitted on
FIRM = 3  #: heavy discount of the level of firm words
FOLDS = 5  #: one part in so many of the labelled texts fits the curve
SLICE = 1 << 19  #: bytes of text whose words a task holds at once
BIN = 0.02  #: step of the ratios that the curve is fitted on
#: Slopes and intercept where the labelled texts cannot fit a curve.
PLAIN_CURVE = (0.0, 0.0, 1.0, 0.0, -2.0)
#: Counts of ordinary (0) and toxic (1) texts: of all labelled ones, and without those of the curve.
COUNTS = ("n0", "n1", "m0", "m1")
RATIOS = ("whole", "by_pairs", "by_words", "by_firm_words")


def held_out(key: Column) -> Column:
    """Rows that learning never sees: CRC-32 of the key as text is a multiple of five."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _words(column: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    for part in slices(pc.utf8_lower(column), size=SLICE, gaps=PUNCTUATION):
        yield part, part.hashes()


def _before(part: Words, h: np.ndarray) -> np.ndarray:
    """The word before each; 0 where a text begins."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[part.bounds[:-1][part.bounds[:-1] < len(h)]] = 0
    return before


def _pair_key(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(before))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _sums() -> list[Column]:
    """``COUNTS`` from rows of a class, whether the curve leaves them alone, and a count."""
    ordinary, rest = F.col("y") == 0, F.col("m") == 1
    return [
        F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
        for name, c in zip(COUNTS, (ordinary, ~ordinary, ordinary & rest, ~ordinary & rest))
    ]


def _pair_counts(texts: DataFrame, known: str | None = None) -> DataFrame:
    """``w, v, y, m, n``: word, previous word, class, fold, and count in a slice of texts.

    With the path ``known`` only pairs of that table are counted.
    """

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, rest = (batch.column(i).to_numpy().astype(np.uint64) for i in (1, 2))
            for part, h in _words(batch.column(0)):
                before, of = _before(part, h), part.first + part.of()
                key = _pair_key(h, before)
                if known is not None:
                    hit = _place(_table(known, "k"), key)[1]
                    h, before, of, key = h[hit], before[hit], of[hit], key[hit]
                kind = label[of] * np.uint64(2) + rest[of]
                _, once, n = np.unique(mix(key + kind), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(h[once]), _signed(before[once]), pa.array((kind[once] >> np.uint64(1)).astype(np.int32)),
                        pa.array((kind[once] & np.uint64(1)).astype(np.int32)), pa.array(n.astype(np.int64)),
                    ],
                    names=["w", "v", "y", "m", "n"],
                )

    return texts.mapInArrow(run, "w long, v long, y int, m int, n long")


def _pair_types(texts: DataFrame) -> DataFrame:
    """``w, v, shown``: word, previous word and which of ``COUNTS`` a slice of texts adds to, as bits."""

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, rest = (batch.column(i).to_numpy().astype(np.int32) for i in (1, 2))
            shown = (1 + 4 * rest) << label
            for part, h in _words(batch.column(0)):
                before = _before(part, h)
                kind = shown[part.first + part.of()]
                once = np.unique(mix(_pair_key(h, before) + kind.astype(np.uint64)), return_index=True)[1]
                yield pa.RecordBatch.from_arrays(
                    [_signed(h[once]), _signed(before[once]), pa.array(kind[once].astype(np.int32))], names=["w", "v", "shown"]
                )

    return texts.mapInArrow(run, "w long, v long, shown int")


def _context_counts(texts: DataFrame) -> DataFrame:
    """``v, y, m, n``: how many words follow each word in a slice of texts; 0 begins a text."""

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, rest = (batch.column(i).to_numpy().astype(np.uint64) for i in (1, 2))
            for part, h in _words(batch.column(0)):
                before, of = _before(part, h), part.first + part.of()
                kind = label[of] * np.uint64(2) + rest[of]
                _, once, n = np.unique(mix(before) + kind, return_index=True, return_counts=True)
                kind = kind[once].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_signed(before[once]), pa.array(kind >> 1), pa.array(kind & 1), pa.array(n.astype(np.int64))],
                    names=["v", "y", "m", "n"],
                )

    return texts.mapInArrow(run, "v long, y int, m int, n long")


def _corpus_counts(documents: DataFrame, text: str, known: str) -> DataFrame:
    """``x, n``: occurrences in all documents of every word of a table; the null row counts all words."""

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _table(known, "x")["x"]
        total, seen = np.zeros(len(words), dtype=np.int64), 0
        for batch in batches:
            for _, h in _words(batch.column(0)):
                at, hit = _place({"x": words}, h)
                total += np.bincount(at[hit], minlength=len(words))
                seen += len(h)
        found = np.flatnonzero(total)
        keys = pa.concat_arrays([_signed(words[found]), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.append(total[found], seen))], names=["x", "n"])

    return documents.select(F.col(f"`{text}`")).mapInArrow(run, "x long, n long").groupBy("x").agg(F.sum("n").alias("n"))


_loaded: dict[str, dict[str, np.ndarray]] = {}


def _table(path: str, key: str) -> dict[str, np.ndarray]:
    """A stored table as arrays in the order of its unsigned key; a worker keeps the last few."""
    if path not in _loaded:
        while len(_loaded) >= 3:
            del _loaded[next(iter(_loaded))]
        fs, folder = pafs.FileSystem.from_uri(path)
        names = [key, *(c for c in ("a", "b", "firm_a", "firm_b") if c in pq.ParquetDataset(folder, filesystem=fs).schema.names)]
        rows = pq.read_table(folder, filesystem=fs, columns=names, use_threads=False)
        keys = rows[key].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        _loaded[path] = {key: keys[order], **{c: rows[c].to_numpy()[order].astype(np.float32) for c in names[1:]}}
        del rows
        pa.default_memory_pool().release_unused()
    return _loaded[path]


def _place(table: dict[str, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value among the table's keys, and whether it is there."""
    keys = next(iter(table.values()))
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _written(frame: DataFrame, purpose: str) -> str:
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return path


def _best_expression(part: Words, ratio: np.ndarray) -> np.ndarray:
    """Highest mean ratio among the expressions of each text; 0 for a text without words."""
    count = np.diff(part.bounds)
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    out = np.zeros(part.n)
    short = (count > 0) & (count <= EXPRESSION)
    a, b = part.bounds[:-1], part.bounds[1:]
    out[short] = (total[b[short]] - total[a[short]]) / count[short]
    long = count > EXPRESSION
    if long.any():
        means = (total[EXPRESSION:] - total[:-EXPRESSION]) / EXPRESSION
        # Windows of one text: from its first word to the last that has a whole expression.
        edges = np.stack([a[long], b[long] - EXPRESSION + 1], axis=1).ravel()
        means = np.append(means, -np.inf)
        out[long] = np.maximum.reduceat(means, edges)[::2]
    return out


def text_ratios(column: pa.Array, words: str, pairs: str, model: str) -> np.ndarray:
    """Log-likelihood ratio a word: of each whole text, of its best expression by pairs, by words and by firm words."""
    out = np.zeros((4, len(column)))
    for part, h in _words(column):
        table = _table(words, "x")
        at, hit = _place(table, h)
        ratio = np.zeros(len(h))
        ratio[hit] = table[f"firm_{model}"][at[hit]]
        here = slice(part.first, part.first + part.n)
        out[3, here] = _best_expression(part, ratio)
        ratio[hit] = table[model][at[hit]]
        known = np.concatenate([[0], np.cumsum(hit)])
        out[2, here] = _best_expression(part, ratio)
        table = _table(pairs, "k")
        at, hit = _place(table, _pair_key(h, _before(part, h)))
        ratio[hit] = table[model][at[hit]]
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        a, b = part.bounds[:-1], part.bounds[1:]
        out[0, here] = (total[b] - total[a]) / np.maximum(known[b] - known[a], 1)
        out[1, here] = _best_expression(part, ratio)
    return out


def _fit_curve(x: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[float, ...]:
    """Slopes and intercept of a logistic curve over binned ratios, lightly regularised; no slope is negative."""
    if not len(x) or label.min() == label.max():
        return PLAIN_CURVE
    use = list(range(x.shape[1]))
    while True:
        z = np.column_stack([x[:, use], np.ones(len(x))])
        beta = np.zeros(z.shape[1])
        penalty = np.diag([1e-2] * len(use) + [1e-4])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
            gradient = z.T @ (n * (label - p)) - penalty @ beta
            hessian = (z * (n * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty
            step = np.linalg.solve(hessian, gradient)
            step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            beta += step
            if np.abs(step).max() < 1e-8:
                break
        worst = int(beta[:-1].argmin()) if use else 0
        if not use or beta[worst] >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[use], out[-1] = beta[:-1], beta[-1]
            return tuple(out.tolist())
        del use[worst]


def discount(ones: int | None, twos: int | None) -> float:
    """What to take from every count of a level with so many counts of one and of two."""
    return ones / (ones + 2 * twos) if ones and twos else DISCOUNT


def _smoothed(count: Column, backoff: Column, total: Column, kinds: Column, taken: float) -> Column:
    """Interpolated estimate of a count among ``kinds`` different ones that sum to ``total``."""
    rest = F.lit(taken) * kinds / total
    return F.when(total > 0, F.greatest(count - taken, F.lit(0.0)) / total + rest * backoff).otherwise(backoff)


def fit_models(labelled: DataFrame, documents: DataFrame, text: str) -> tuple[str, str]:
    """Paths of the tables of words (``x, a, b``) and of pairs (``k, a, b``).

    ``labelled`` holds text, label and 1 for texts that the curve leaves alone; ``a`` is the log-likelihood
    ratio by models of all labelled texts, ``b`` by those that the curve leaves alone.
    """
    # Types of pairs, each counted for its word and for its context in one step.
    types = _pair_types(labelled).groupBy("w", "v").agg(F.bit_or("shown").alias("shown"))
    sides = types.select(
        F.explode(F.array(F.struct(F.col("w").alias("x"), F.lit(1).alias("is_word")), F.struct(F.col("v").alias("x"), F.lit(0).alias("is_word")))).alias("_side"),
        "shown",
    ).select("_side.*", *[(F.col("shown").bitwiseAND(1 << i) > 0).alias(c) for i, c in enumerate(COUNTS)])
    is_word = F.col("is_word") == 1
    words = stored(
        sides.groupBy("x").agg(
            *[F.sum((is_word & F.col(c)).cast("long")).alias(f"contexts_{c}") for c in COUNTS],
            *[F.sum((~is_word & F.col(c)).cast("long")).alias(f"kinds_{c}") for c in COUNTS],
        ),
        "toxicity-words",
    )
    release(documents.sparkSession)  # the largest shuffles of the operator
    known = _written(words.select("x"), "toxicity-vocabulary")
    counts = stored(_corpus_counts(documents, text, known), "toxicity-backoff")
    every = counts.where("x is null").first()
    sums = words.agg(
        *[F.sum(f"contexts_{c}").alias(f"total_{c}") for c in COUNTS],
        *[F.sum((F.col(f"contexts_{c}") > 0).cast("long")).alias(f"words_{c}") for c in COUNTS],
        *[F.sum((F.col(f"contexts_{c}") == k).cast("long")).alias(f"words_{k}_{c}") for k in (1, 2) for c in COUNTS],
        *[F.sum(F.least(F.col(f"contexts_{c}"), F.lit(FIRM))).alias(f"firm_{c}") for c in COUNTS],
    ).first()
    taken = {c: discount(sums[f"words_1_{c}"], sums[f"words_2_{c}"]) for c in COUNTS}
    shared = F.coalesce(F.col("n"), F.lit(1)) / F.lit(float(max(1, every["n"] if every else 1)))
    level = words.join(counts, "x", "left").select(
        "x",
        *[
            _smoothed(
                F.col(f"contexts_{c}"), shared, F.lit(float(sums[f"total_{c}"] or 0)), F.lit(float(sums[f"words_{c}"] or 0)),
                taken[c],
            ).alias(f"p_{c}")
            for c in COUNTS
        ],
        *[
            ((F.greatest(F.col(f"contexts_{c}") - FIRM, F.lit(0)) + float(sums[f"firm_{c}"] or 0) * shared) / float(sums[f"total_{c}"] or 1)).alias(f"firm_{c}")
            for c in COUNTS
        ],
        *[f"{kind}_{c}" for kind in ("contexts", "kinds") for c in COUNTS],
    )
    level = stored(level, "toxicity-level")

    def ratio(p: str, level: str = "p") -> Column:
        both = bool(sums[f"total_{p}0"]) and bool(sums[f"total_{p}1"])
        return (F.ln(f"{level}_{p}1") - F.ln(f"{level}_{p}0")) if both else F.lit(0.0)


    def firm_ratio(p: str) -> Column:
        firm = (F.col(f"contexts_{p}0") > FIRM) | (F.col(f"contexts_{p}1") > FIRM)
        return F.when(firm, ratio(p, "firm")).otherwise(0.0)

    word_path = _written(
        level.select("x", *[f(p).alias(f"{kind}{name}") for kind, f in (("", ratio), ("firm_", firm_ratio)) for p, name in (("n", "a"), ("m", "b"))]),
        "toxicity-word-model",
    )
    # Pairs of toxic texts, then their counts in ordinary ones.
    toxic = _with_key(_pair_counts(labelled.where("_label = 1")).groupBy("w", "v").agg(*_sums()))
    toxic = stored(toxic, "toxicity-pairs")
    few = toxic.agg(*[F.sum((F.col(c) == k).cast("long")).alias(f"{c}_{k}") for c in ("n1", "m1") for k in (1, 2)]).first()
    of_pairs = {p: discount(few[f"{p}1_1"], few[f"{p}1_2"]) for p in ("n", "m")}
    pair_keys = _written(toxic.select("k"), "toxicity-pair-keys")
    ordinary = _pair_counts(labelled.where("_label = 0"), pair_keys).groupBy("w", "v").agg(*_sums())
    both = toxic.select("k", "w", "v", "n1", "m1").join(ordinary.select("w", "v", "n0", "m0"), ["w", "v"], "left").fillna(0, ["n0", "m0"])
    context = level.select(F.col("x").alias("v"), *[f"kinds_{c}" for c in COUNTS]).join(
        _context_counts(labelled).groupBy("v").agg(*_sums()).toDF("v", *[f"after_{c}" for c in COUNTS]), "v"
    )
    of_word = level.select(F.col("x").alias("w"), *[f"p_{c}" for c in COUNTS])
    joined = both.join(of_word, "w").join(context, "v").select(
        "k", "m1", *[F.col(f"p_{c}").alias(f"word_{c}") for c in COUNTS],
        *[_smoothed(F.col(c), F.col(f"p_{c}"), F.col(f"after_{c}"), F.col(f"kinds_{c}"), of_pairs[c[0]]).alias(f"p_{c}") for c in COUNTS],
    )
    as_word = (F.ln("word_m1") - F.ln("word_m0")) if sums["total_m0"] and sums["total_m1"] else F.lit(0.0)
    b = F.when(F.col("m1") > 0, ratio("m")).otherwise(as_word)
    return word_path, _written(joined.select("k", ratio("n").alias("a"), b.alias("b")), "toxicity-pair-model")


def _with_key(pairs: DataFrame) -> DataFrame:
    """Pairs with ``k``, the key by which texts find them."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("k", T.LongType())])

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, v = (batch.column(c).to_numpy().view(np.uint64) for c in ("w", "v"))
            yield pa.RecordBatch.from_arrays([*batch.columns, _signed(_pair_key(w, v))], names=schema.names)

    return pairs.mapInArrow(run, schema)


def score_toxicity(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "toxic", max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """Add ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row.

    Learns from at most ``max_labelled`` labelled rows whose key is not held out, chosen by hash;
    rows with a null key or label teach nothing, of repeated labels of a key the largest holds, and
    equal texts teach once, by the largest of their labels.  The score depends on the text alone.
    Null counts as empty; texts without words have ratios of zero.  Repeated rows are scored one by
    one.  Without labelled rows of both classes every text gets the same score.  Columns of those
    three names are replaced; others may have any name.
    """
    own = ("held_out", "score", "predicted")
    kept = [c for c in documents.columns if c.lower() not in own]
    docs = documents.select(*[F.col(f"`{c}`") for c in kept])
    # At most max_labelled rows of a key and a number: small enough for every executor.
    teaching = stored(
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_key"))
        .agg((F.max(label) > 0).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(max_labelled),
        "toxicity-labels",
    )
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    texts = texts.withColumn("_hash", F.xxhash64("_text"))
    once = stored(
        texts.join(F.broadcast(teaching), "_key")
        .groupBy("_hash")
        .agg(F.min("_key").alias("_key"), F.max("_label").alias("_label")),
        "toxicity-texts",
    )
    rest = (F.pmod("_hash", F.lit(FOLDS)) != 0).cast("int").alias("_rest")
    # A key that repeats with one text teaches as often as it repeats.
    labelled = texts.join(F.broadcast(once), ["_key", "_hash"]).select("_text", "_label", rest)
    words, pairs = fit_models(labelled, docs, text)

    @sparing
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = np.rint(text_ratios(batch.column(0), words, pairs, "b") / BIN).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, steps), batch.column(1)], names=[*RATIOS, "y"])

    # The curve sees counts per step of the ratios, fewer rows than labelled texts.
    binned = (
        labelled.where("_rest = 0").select("_text", "_label")
        .mapInArrow(fitted, ", ".join(f"{r} long" for r in RATIOS) + ", y int")
        .groupBy(*RATIOS, "y").count().orderBy(*RATIOS, "y").toPandas()
    )
    curve = _fit_curve(
        binned[list(RATIOS)].to_numpy(dtype=float) * BIN, binned["y"].to_numpy(dtype=float), binned["count"].to_numpy(dtype=float)
    )
    # Numbered columns inside: names may hold dots, or clash.
    rows = docs.toDF(*[f"_{i}" for i in range(len(kept))])
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text)

    @sparing
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratios = text_ratios(batch.column(at), words, pairs, "a")
            z = np.clip(np.array(curve[:-1]) @ ratios + curve[-1], -700, 700)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=schema.names)

    return rows.mapInArrow(scored, schema).select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)],
        held_out(F.col(f"_{docs.columns.index(key)}")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
