"""Substring dedup: words covered by a repeated run of at least ``length`` words are removed.

The suffixes of the corpus are split by a prefix, and each part is a subtree of the corpus' suffix
tree that fits in memory:

* Every window of ``length`` words holds one *anchor*, its run of ``ANCHOR`` words with the smallest
  hash (the leftmost of equal ones).  Equal windows have equal anchors at the same place, so the
  windows that can repeat lie in parts whose anchor occurs at least twice; all others are discarded
  after a count of anchors, before any text moves.
* The windows of one anchor travel as one *run* of text, from the first word of the first window to
  the last word of the last, and equal runs are summed first: copies cost nothing further on.
* The first prefix of a part is its anchor.  A part with more windows than fit is split by its
  windows' own first words, by longer and longer prefixes, up to whole windows.
* Within a part, the windows are suffixes cut at ``length`` words; sorted, they are the leaves of
  the subtree, and those that share all of their words with a neighbour (or stand for several
  places) hang below an internal node at least ``length`` words deep: a maximal repeat.

Texts are taken once each, with the number of rows that hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.memory import sparing
from fleetlens.llm.storage import release, shuffle_partitions, stored
from fleetlens.llm.wordbatch import Words, gram_hashes, slices, words_of

LENGTH = 35
ANCHOR = 8
PART_WINDOWS = 200_000  #: windows of a part that one task sorts at a time
PREFIXES = (10, 18, 26)  #: words of the longer prefixes of parts that hold more


def _anchors(h: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: first window, number of windows, anchor hash."""
    n = len(h)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none.astype(np.uint64)
    grams = gram_hashes(h, ANCHOR)
    span = length - ANCHOR + 1
    # Smallest value of every ``span`` adjacent grams, and its leftmost place, by doubling.
    best, at, have = grams, np.arange(len(grams)), 1
    while have < span:
        step = min(have, span - have)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        have += step
    inside = np.zeros(len(best), dtype=bool)
    size = np.diff(bounds)
    for a, k in zip(bounds[:-1][size >= length].tolist(), size[size >= length].tolist()):
        inside[a : a + k - length + 1] = True
    windows = np.flatnonzero(inside)
    if not len(windows):
        return none, none, none.astype(np.uint64)
    place = at[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    # Windows next to each other in different texts never share an anchor: it lies inside a text.
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    return windows[first], count, best[windows[first]]


def _text_runs(part: Words, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text that has a window: its number, and first word, windows and anchor of its runs."""
    start, count, anchor = _anchors(part.hashes(), part.bounds, length)
    owner = np.searchsorted(part.bounds, start, side="right") - 1
    cut = np.searchsorted(owner, np.arange(part.n + 1))
    for t in np.unique(owner).tolist():
        s = slice(cut[t], cut[t + 1])
        yield t, start[s] - part.bounds[t], count[s], anchor[s]


def _text_anchors(texts: DataFrame, length: int) -> DataFrame:
    """``key, short, anchors``: the anchors of every text with at least one window."""

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                rows, lists, sizes = [], [], []
                for t, _, _, anchor in _text_runs(part, length):
                    once, times = np.unique(anchor, return_counts=True)
                    # An anchor at several places of one text comes twice: enough to be shared.
                    both = np.concatenate([once, once[times > 1]])
                    rows.append(part.first + t)
                    lists.append(both.view(np.int64))
                    sizes.append(len(both))
                if rows:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    anchors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                    who = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*who, anchors], names=["key", "short", "anchors"])

    return texts.mapInArrow(run, "key binary, short long, anchors array<long>")


def _shared_runs(texts: DataFrame, length: int) -> DataFrame:
    """``anchor, id, run, windows, first, key, rows`` from ``texts (key, packed, wanted, rows)``.

    A row per run of a text whose anchor is wanted; the words of a run (one per line) come with its
    first row in a task only, ``id`` is their digest.
    """
    names = ["anchor", "id", "run", "windows", "first", "key", "rows"]

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        seen: set[bytes] = set()
        for batch in batches:
            keys, packed, rows = (batch.column(i).to_pylist() for i in (0, 1, 3))
            wanted = batch.column(2)
            at = 0
            while at < len(packed):
                raw, stop, size = [], at, 0
                while stop < len(packed) and size < 1 << 21:
                    raw.append(open_.decompress(packed[stop]))
                    size += len(raw[-1])
                    stop += 1
                bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
                part = words_of(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
                lines = part.lines(np.arange(len(part.start)))
                line = np.concatenate([[0], np.cumsum(part.end - part.start + 1)])
                out: list[list] = [[] for _ in names]
                for t, first, count, anchor in _text_runs(part, length):
                    shared = np.isin(anchor.view(np.int64), wanted[at + t].values.to_numpy())
                    first, count, anchor = first[shared], count[shared], anchor[shared].view(np.int64)
                    begin = line[part.bounds[t] + first]
                    end = line[part.bounds[t] + first + count + length - 1] - 1
                    for a, b in zip(begin.tolist(), end.tolist()):
                        words = lines[a:b]
                        digest = hashlib.md5(words).digest()
                        out[1].append(digest)
                        out[2].append(None if digest in seen else words)
                        seen.add(digest)
                    out[0] += anchor.tolist()
                    out[3] += count.tolist()
                    out[4] += first.tolist()
                    out[5] += [keys[at + t]] * len(first)
                    out[6] += [rows[at + t]] * len(first)
                if out[0]:
                    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)
                if len(seen) > 1 << 20:
                    seen.clear()
                at = stop

    return texts.mapInArrow(run, "anchor long, id binary, run binary, windows int, first long, key binary, rows long")


def subtree_repeats(runs: list[bytes], copies: list[int], length: int) -> list[int]:
    """For each run, a bit mask of its windows that occur more than once among all runs.

    The windows are sorted as suffixes; equal neighbours share an internal node ``length`` deep.
    """
    suffixes: list[tuple[bytes, int, int]] = []
    for i, run in enumerate(runs):
        breaks = [-1, *[j for j, c in enumerate(run) if c == 0x0A], len(run)]
        for w in range(len(breaks) - length):
            suffixes.append((run[breaks[w] + 1 : breaks[w + length]], i, w))
    suffixes.sort()
    masks = [0] * len(runs)
    at = 0
    while at < len(suffixes):
        stop = at + 1
        while stop < len(suffixes) and suffixes[stop][0] == suffixes[at][0]:
            stop += 1
        if stop - at > 1 or copies[suffixes[at][1]] > 1:
            for _, i, w in suffixes[at:stop]:
                masks[i] |= 1 << w
        at = stop
    return masks


def _subtrees(parts: DataFrame, length: int) -> DataFrame:
    """``run, mask`` of the runs with repeats; ``parts (prefix, run, copies)`` come sorted by prefix."""

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, runs, copies = None, [], []
        out: tuple[list, list] = ([], [])

        def close() -> None:
            for r, m in zip(runs, subtree_repeats(runs, copies, length)):
                if m:
                    out[0].append(r)
                    out[1].append(m)

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64())], names=["run", "mask"])
            out[0].clear()
            out[1].clear()
            return batch

        for batch in batches:
            for p, r, c in zip(*(column.to_pylist() for column in batch.columns)):
                if p != prefix:
                    close()
                    prefix, runs, copies = p, [], []
                    if len(out[0]) > 5000:
                        yield emit()
                runs.append(r)
                copies.append(c)
        close()
        if out[0]:
            yield emit()

    return parts.mapInArrow(run, "run binary, mask long")


def _windows(runs: DataFrame, length: int) -> DataFrame:
    """Every window of the runs as a run of its own, with the run and the place it came from."""

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = r.split(b"\n")
                n = len(words) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r] * n, pa.binary()), pa.array(range(n), pa.int32()),
                        pa.array([b"\n".join(words[i : i + length]) for i in range(n)], pa.binary()), pa.array([c] * n, pa.int64()),
                    ],
                    names=["run", "place", "window", "copies"],
                )

    return runs.mapInArrow(run, "run binary, place int, window binary, copies long")


def repeated_runs(
    runs: DataFrame, length: int, part_windows: int = PART_WINDOWS, prefixes: tuple[int, ...] = PREFIXES
) -> DataFrame:
    """``run, mask`` of the distinct runs ``(anchor, run, windows, copies)`` that hold a repeat."""
    spark = runs.sparkSession
    large = stored(
        runs.groupBy("anchor").agg(F.sum("windows").alias("size")).where(F.col("size") > part_windows).select("anchor"),
        "large-parts",
    )
    small = runs.join(large, "anchor", "left_anti")
    ordered = small.select("anchor", "run", "copies").repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor", "run")
    found = _subtrees(ordered, length)
    if large.isEmpty():
        return found
    # Windows of the large parts, equal ones summed, split by the shortest prefix that makes them fit.
    windows = stored(_windows(runs.join(large, "anchor", "left_semi").select("run", "copies"), length), "split-windows")
    left = stored(windows.groupBy("window").agg(F.sum("copies").alias("copies")), "split-distinct")
    repeats = spark.createDataFrame([], "window binary")
    for words in prefixes:
        keyed = left.withColumn("prefix", F.xxhash64(F.substring_index(F.col("window").cast("string"), "\n", words)))
        crowded = stored(
            keyed.groupBy("prefix").count().where(F.col("count") > part_windows).select("prefix"), f"crowded-{words}"
        )
        fits = keyed.join(crowded, "prefix", "left_anti").select("prefix", F.col("window").alias("run"), "copies")
        part = _subtrees(fits.repartition(shuffle_partitions(spark), "prefix").sortWithinPartitions("prefix", "run"), length)
        repeats = repeats.unionByName(part.select(F.col("run").alias("window")))
        left = stored(keyed.join(crowded, "prefix", "left_semi").drop("prefix"), f"split-{words}")
    # Whole windows: each is a part of its own.
    repeats = repeats.unionByName(left.where("copies > 1").select("window"))
    masks = windows.join(repeats, "window").groupBy("run").agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask"))
    return found.unionByName(masks)


def _packed(frame: DataFrame) -> DataFrame:
    """Compress the last column, a string, into a binary ``packed``: text is what the shuffles carry."""
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("packed", T.BinaryType())])

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            *others, text = batch.columns
            packed = pa.array([squeeze.compress(t.encode()) for t in text.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*others, packed], names=schema.names)

    return frame.mapInArrow(run, schema)


def _cut(frame: DataFrame, length: int, fields: list[T.StructField]) -> DataFrame:
    """Apply ``whole`` and ``spans`` to ``packed``, the last three columns."""
    schema = T.StructType(
        [
            *fields, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )
    spans_kind = pa.list_(pa.list_(pa.int64()))

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            *others, packed, whole, spans = batch.columns
            for at in range(0, batch.num_rows, 1000):
                whole_texts, counts, removed, texts, places = [], [], [], [], []
                part = slice(at, at + 1000)
                for raw, all_of, found in zip(*(c[part].to_pylist() for c in (packed, whole, spans))):
                    body = open_.decompress(raw)
                    whole_texts.append(body.decode())
                    words = body.split()
                    n = len(words)
                    counts.append(n)
                    if all_of and n >= length:
                        gone = np.ones(n, dtype=bool)
                    elif found:
                        edge = np.zeros(n + 1, dtype=np.int64)
                        for x in found:
                            first, mask, w = x["first"], x["mask"], 0
                            while mask >> w:
                                if mask >> w & 1:
                                    edge[first + w] += 1
                                    edge[first + w + length] -= 1
                                w += 1
                        gone = np.cumsum(edge[:-1]) > 0
                    else:
                        removed.append(0)
                        texts.append(b" ".join(words).decode())
                        places.append([])
                        continue
                    step = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    removed.append(int(gone.sum()))
                    places.append(step.reshape(-1, 2).tolist())
                    texts.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]).decode())
                values = [pa.array(whole_texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(places, spans_kind)]
                yield pa.RecordBatch.from_arrays([*(c[part] for c in others), *values], names=schema.names)

    return frame.mapInArrow(run, schema)


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, text: str = "text", part_windows: int = PART_WINDOWS
) -> DataFrame:
    """Add ``n_words``, ``n_removed``, ``kept_text`` and ``removed`` (spans of word numbers, end exclusive).

    A word is removed if a window of ``length`` words that covers it starts anywhere else too, in the
    same document included; windows are judged on the input.  ``kept_text`` has the kept words
    joined by one space.  Null counts as empty.  Repeated rows count as places of their own, whatever
    their other columns hold.  An empty table gives an empty result; columns of those names are
    replaced.
    """
    if not ANCHOR <= length <= ANCHOR + 55:
        raise ValueError("the windows of one run must fit the bits of a mask")
    spark = documents.sparkSession
    own = ("n_words", "n_removed", "kept_text", "removed")
    kept = [c for c in documents.columns if c not in (*own, "_null")]
    docs = documents.select(*[F.col(f"`{c}`") for c in kept])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.unhex(F.md5(body.cast("binary")))
    # One row per distinct text: how many rows hold it, and its anchors.
    found = _text_anchors(docs.select(key.alias("key"), F.xxhash64(body).alias("short"), body.alias("text")), length)
    texts = stored(
        found.groupBy("key").agg(F.count("*").alias("rows"), F.first("short").alias("short"), F.first("anchors").alias("anchors")),
        "anchors",
    )
    release(spark)
    # Texts whose short keys clash only get each other's anchors too.
    places = texts.select("short", F.explode("anchors").alias("anchor"))
    twice = places.groupBy("anchor").count().where("count > 1").select("anchor")
    wanted = stored(places.join(twice, "anchor").groupBy("short").agg(F.collect_set("anchor").alias("wanted")), "wanted")
    release(spark)
    carriers = texts.select("key", "short", "rows").join(wanted, "short").select("key", "rows", "wanted")
    packed = _packed(docs.select(key.alias("key"), body.alias("text"))).groupBy("key").agg(F.first("packed").alias("packed"))
    runs = stored(
        _shared_runs(packed.join(carriers, "key").select("key", "packed", "wanted", "rows"), length), "runs"
    )
    release(spark)
    distinct = stored(
        runs.groupBy("anchor", "id").agg(
            F.max("run").alias("run"), F.max("windows").alias("windows"), F.sum("rows").alias("copies")
        ),
        "distinct-runs",
    )
    masks = repeated_runs(distinct, length, part_windows)
    spans = (
        runs.select("id", "key", "first")
        .join(masks.select(F.unhex(F.md5("run")).alias("id"), "mask"), "id")
        .groupBy("key")
        .agg(F.collect_list(F.struct("first", "mask")).alias("spans"))
    )
    verdicts = stored(
        texts.where("rows > 1").select("key", F.lit(True).alias("whole")).join(spans, "key", "full"), "verdicts"
    )
    release(spark)
    rest = [*[F.col(f"`{c}`") for c in kept if c != text], F.col(f"`{text}`").isNull().alias("_null")]
    judged = (
        _packed(docs.select(F.struct(*rest).alias("row"), key.alias("key"), body.alias("text")))
        .join(verdicts, "key", "left")
        .select("row", "packed", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    )
    return _cut(judged, length, [judged.schema["row"]]).select(
        *[F.when(F.col("row._null"), F.lit(None)).otherwise(F.col("text")).alias(c) if c == text else F.col(f"row.`{c}`") for c in kept],
        *own,
    )
