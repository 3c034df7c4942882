"""Importance resampling towards a target: hashed n-gram gains, Gumbel keys, exact top share.

Features are the runs of one to three adjacent words, hashed by CRC-32 into buckets.  A bucket's gain
is the scaled log ratio of its smoothed shares in the target and in the corpus; a document's weight is
the sum of the gains of its features, looked up as arrays.  A Gumbel variable drawn from the document's
id is added, so that the highest scores are a sample without replacement with those weights.

The cutoff is found by weighted median-of-medians selection: every partition reports the median of its
remaining keys with their number; the weighted median of these is a key with at least about a quarter
of the remaining keys on either side, one side of which is discarded.  Only then are the winners sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.ranking import ranked
from fleetlens.llm.storage import stored
from fleetlens.llm.wordbatch import Words, slices

BUCKETS = 10_000
SCALE = 1000
SEED = 42
MIN_WORDS = 20
PERCENT = 5
#: So many remaining keys end the selection: they are sorted on the driver, 24 bytes each.
FEW_KEYS = 4096
#: The remaining keys are written down anew when they are less than this part of the last copy.
REWRITE = 8

_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_GAPS = ~_WORD_BYTE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

# CRC-32 of joined parts: crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where a shift by one byte is a
# step of the register over a zero byte.  Shifts are linear, so each is a table per register byte.
_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
_SPACE_CRC = np.uint32(zlib.crc32(b" "))
_DIRECT = 64  #: shifts by fewer bytes have a table of their own, others go by powers of two


def _zero_byte(state: np.ndarray) -> np.ndarray:
    return _STEP[state & 255] ^ (state >> np.uint32(8))


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    table = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    direct = [table]
    for _ in range(_DIRECT):
        direct.append(_zero_byte(direct[-1]))
    powers = [direct[1]]
    for _ in range(31):
        powers.append(_applied(powers[-1], powers[-1]))
    return np.stack(direct[:_DIRECT]), np.stack(powers)


def _applied(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 255] ^ table[1][(state >> 8) & 255] ^ table[2][(state >> 16) & 255] ^ table[3][state >> 24]


_SHIFT, _POWERS = _shift_tables()


def _shift(state: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Registers after ``size`` zero bytes each."""
    near = np.minimum(size, _DIRECT - 1)
    out = (
        _SHIFT[near, 0, state & 255] ^ _SHIFT[near, 1, (state >> 8) & 255]
        ^ _SHIFT[near, 2, (state >> 16) & 255] ^ _SHIFT[near, 3, state >> 24]
    )
    far = np.flatnonzero(size >= _DIRECT)
    if len(far):
        value, left = state[far], size[far]
        for bit in range(int(left.max()).bit_length()):
            on = (left >> bit) & 1 == 1
            value[on] = _applied(_POWERS[bit], value[on])
        out[far] = value
    return out


def _word_crcs(part: Words) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and length of every word, letters A-Z lower-cased."""
    data = _LOWER[part.data]
    size = part.end - part.start
    state = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    live = np.flatnonzero(size < _DIRECT)
    at = 0
    while len(live):
        state[live] = _STEP[(state[live] ^ data[part.start[live] + at]) & 255] ^ (state[live] >> np.uint32(8))
        at += 1
        live = live[size[live] > at]
    crc = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size >= _DIRECT).tolist():
        crc[i] = zlib.crc32(data[part.start[i] : part.end[i]].tobytes())
    return crc, size


def feature_buckets(part: Words, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 and 3 words: bucket per first word, and which of them stay inside one text."""
    crc, size = _word_crcs(part)
    of = part.of()
    out, run = [], crc
    for more in range(3):
        n = len(crc) - more
        if n <= 0:
            break
        if more:
            spaced = _zero_byte(run[:n]) ^ _SPACE_CRC
            run = _shift(spaced, size[more:]) ^ crc[more:]
        out.append(((run % np.uint32(buckets)).astype(np.int64), of[:n] == of[more:]))
    return out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over the features of the one string column; summed inside every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0), gaps=_GAPS):
                for bucket, inside in feature_buckets(part, buckets):
                    total += np.bincount(bucket[inside], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> list[int]:
    """At most ``buckets`` numbers, whatever the size of the corpus."""
    out = [0] * buckets
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)), each count raised by one."""
    s_all, t_all = float(sum(corpus) + len(corpus)), float(sum(target) + len(target))
    return np.array(
        [math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus, target)],
        dtype=np.int64,
    )


def _noise(doc_id: int | None, seed: int) -> int:
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(frame: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """``rest, _id, n_words, n_features, weight, score`` from ``rest, _id, _text``."""
    schema = T.StructType(
        [*frame.schema.fields[:2], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            weight = np.zeros(batch.num_rows, dtype=np.int64)
            for part in slices(batch.column(2), gaps=_GAPS):
                rows = slice(part.first, part.first + part.n)
                n_words[rows] = np.diff(part.bounds)
                for bucket, inside in feature_buckets(part, len(gains)):
                    total = np.zeros(len(part.start) + 1, dtype=np.int64)
                    np.cumsum(gains[bucket] * inside, out=total[1 : len(bucket) + 1])
                    total[len(bucket) + 1 :] = total[len(bucket)]
                    weight[rows] += np.diff(total[part.bounds])
            n_features = n_words + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)
            noise = np.array([_noise(i, seed) for i in batch.column(1).to_pylist()], dtype=np.int64)
            numbers = (n_words, n_features, weight, weight + noise)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, numbers)], names=schema.names)

    return frame.mapInArrow(run, schema)


_KEY = ("worse", "last", "row")  #: smaller is better: negative score, id, place of the row


def _partition_medians(keys: DataFrame) -> list[tuple[tuple[int, int, int], int]]:
    """Median key and number of keys of every partition that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if held:
            worse, last, row = (np.concatenate(c) for c in zip(*held))
            middle = np.lexsort((row, last, worse))[(len(row) - 1) // 2]
            values = [[worse[middle]], [last[middle]], [row[middle]], [len(row)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=[*_KEY, "n"])

    found = keys.mapInArrow(run, "worse long, last long, row long, n long").collect()
    return sorted((tuple(r)[:3], r["n"]) for r in found)


def _key() -> Column:
    return F.struct(*_KEY)


def _at(key: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(key, _KEY)])


def cutoff_key(keys: DataFrame, k: int, few: int = FEW_KEYS) -> tuple[int, int, int] | None:
    """The ``k``-th smallest of the unique keys (None for ``k = 0``).

    Every round discards at least about a quarter of the remaining keys, so rounds grow with the
    logarithm of the rows.  A partition's keys (24 bytes a row) are held by the task that sorts them;
    the driver sees one row per partition, and at most ``few`` keys at the end.
    """
    if k < 1:
        return None
    left, copied = keys, None
    while True:
        medians = _partition_medians(left)
        total = sum(n for _, n in medians)
        if k > total:
            raise ValueError(f"only {total} keys")
        if total <= few:
            return tuple(left.orderBy(*_KEY).collect()[k - 1])
        if copied is None or total * REWRITE < copied:
            left, copied = stored(left, "selection"), total
        below = 0
        for pivot, n in medians:
            below += n
            if 2 * below >= total:
                break
        at_most = left.where(_key() <= _at(pivot)).count()
        if at_most == k:
            return pivot
        if at_most > k:
            left = left.where(_key() <= _at(pivot))
        else:
            left, k = left.where(_key() > _at(pivot)), k - at_most


def importance_resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text: str = "text",
    keep_text: bool = True,
    few: int = FEW_KEYS,
) -> DataFrame:
    """Add ``n_features, weight, score, rank``; drawn rows have ranks 1, 2, 3... by score, the others null.

    ``target`` has a column ``text``.  ``percent`` of the documents with ``min_words`` words are drawn,
    ties to the smaller id (none comes last), then in the order read.  Null texts count as empty, a
    null id draws its noise from the bare seed, and repeated rows are drawn one by one.  Other columns
    keep their values, whatever their names; columns of the four names are replaced.  An empty table
    gives an empty result; an empty target weighs features by their rarity.
    """
    own = ("n_features", "weight", "score", "rank")
    kept = [c for c in documents.columns if c not in own and (keep_text or c != text)]
    corpus = _dense(bucket_counts(documents.select(F.col(f"`{text}`")), buckets), buckets)
    wanted = _dense(bucket_counts(target.select("text"), buckets), buckets)
    frame = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest"),
        F.col(f"`{id_column}`").cast("long").alias("_id"),
        F.col(f"`{text}`").alias("_text"),
    )
    last = F.coalesce("_id", F.lit(2**63 - 1))
    scored = stored(
        _scored(frame, bucket_gains(corpus, wanted), seed)
        .withColumn("worse", -F.col("score")).withColumn("last", last).withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    able = scored.where(F.col("n_words") >= min_words)
    cutoff = cutoff_key(able.select(*_KEY), percent * able.count() // 100, few)
    drawn = F.lit(False) if cutoff is None else (F.col("n_words") >= min_words) & (_key() <= _at(cutoff))
    winners = ranked(scored.where(drawn).select("rest", "n_features", "weight", "score", *_KEY), [F.col(c) for c in _KEY])
    others = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    both = winners.withColumn("rank", F.col("rank") + 1).select("rest", *own).unionByName(others.select("rest", *own))
    return both.select(*[F.col(f"rest.`{c}`").alias(c) for c in kept], *own)
