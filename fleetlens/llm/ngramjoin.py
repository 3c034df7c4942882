"""Near-duplicate documents: an n-gram Jaccard self-join through a MinHash LSH forest.

Every document has a label in each tree: the MinHash values of its word shingles, one byte each, as
one number.  Numbers in sorted order are the leaves of a prefix trie, and a shift of a number is a
node above its leaf.  The matched prefix starts at the full label and is shortened until a pair at
the threshold shares a node in some tree with the target probability; nodes of longer prefixes lie
below those of shorter ones, so only the last length needs to be grouped.

Documents with equal shingle sets are one class.  Classes that share a node hang on the node's
smallest class, which is a link per class and tree whatever the size of the node; the connected
classes form a cluster.  Within a cluster the exact Jaccard similarities are counted block by block,
so every pair is verified and none is ever a row.
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

from fleetlens.llm.components import connected_components
from fleetlens.llm.memory import sparing
from fleetlens.llm.storage import release, shuffle_partitions, stored
from fleetlens.llm.wordbatch import Words, gram_hashes, mix, ranges, slices, words_of

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8  #: bytes of a label
RECALL = 0.999
BLOCK = 512  #: documents of a cluster that one task compares with as many others
KEY_BITS = 24  #: of a text key, that decide before a shuffle whether a text can be needed
BAND = 1.25  #: sets whose sizes differ by more than this factor cannot reach 0.8


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix at which a pair at the threshold shares a node with the wanted probability."""
    for length in range(depth, 1, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    return 1


def shingles(part: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts, and the bounds of each text.

    A text of fewer words has one shingle, all of its words; one without words has none.
    """
    h = part.hashes()
    count = np.diff(part.bounds)
    grams = gram_hashes(h, k)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(size)])
    starts = part.bounds[:-1].copy()
    whole = (count > 0) & (count < k)
    # Short texts: their words in order, hashed apart from whole shingles.
    short = np.zeros(int(whole.sum()), dtype=np.uint64)
    for i in range(k - 1):
        there = count[whole] > i
        short[there] = mix(short[there] * np.uint64(31) + h[starts[whole][there] + i])
    out = np.zeros(int(bounds[-1]), dtype=np.uint64)
    full = count >= k
    out[ranges(bounds[:-1][full], size[full])] = grams[ranges(starts[full], size[full])]
    out[bounds[:-1][whole]] = short
    return out, bounds


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tree_labels(grams: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """(texts with shingles, trees) labels: ``depth`` bytes of MinHash values from the top."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), trees), dtype=np.uint64)
    if not len(starts):
        return out
    factors = _multipliers(trees * depth)
    for tree in range(trees):
        for level in range(depth):
            least = np.minimum.reduceat(grams * factors[tree * depth + level], starts)
            out[:, tree] |= (mix(least) & np.uint64(0xFF)) << np.uint64(8 * (depth - 1 - level))
    return out


def _signed(documents: DataFrame, trees: int, depth: int) -> DataFrame:
    """``id, text_key, set_key, n, labels`` of every document ``(id, text)``."""

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), size=1 << 19):
                grams, bounds = shingles(part)
                has = np.flatnonzero(np.diff(bounds))
                labels = tree_labels(grams, bounds, trees, depth)
                n, keys, texts = [], [], []
                for a, b in zip(bounds[:-1][has].tolist(), bounds[1:][has].tolist()):
                    one = np.unique(grams[a:b])
                    n.append(len(one))
                    keys.append(np.array([mix(one).sum(), mix(one ^ np.uint64(0x5851F42D4C957F2D)).sum()]).tobytes())
                raw = part.data.tobytes()
                texts = [hashlib.md5(raw[part.text_bounds[t] : part.text_bounds[t + 1]]).digest() for t in has.tolist()]
                ends = np.arange(0, len(has) * trees + 1, trees, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(part.first + has)), pa.array(texts, pa.binary()), pa.array(keys, pa.binary()),
                        pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(labels.ravel().view(np.int64))),
                    ],
                    names=["id", "text_key", "set_key", "n", "labels"],
                )

    return documents.mapInArrow(run, "id long, text_key binary, set_key binary, n long, labels array<long>")


def _key_bits(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the first ``KEY_BITS`` bits of a key: a fixed size for any number of keys."""
    front = F.conv(F.hex(F.substring("text_key", 1, KEY_BITS // 8)), 16, 10).cast("long")
    found = (
        keys.select(front.alias("front"))
        .groupBy(F.shiftright("front", 6).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(front & 63 as int)))").alias("bits"))
        .toPandas()
    )
    out = np.zeros((1 << KEY_BITS) // 64, dtype=np.uint64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _packed(documents: DataFrame, bits) -> DataFrame:
    """``text_key, packed`` from ``text``: compressed text is what the shuffle carries.

    Texts whose key has no bit set are left out; a few others that nobody asked for may remain.
    """

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        wanted = bits.value
        for batch in batches:
            raw = [t.encode() for t in batch.column(0).to_pylist()]
            keys = [hashlib.md5(r).digest() for r in raw]
            front = np.array([int.from_bytes(k[: KEY_BITS // 8], "big") for k in keys], dtype=np.int64)
            hit = np.flatnonzero(wanted[front >> 6] >> (front & 63).astype(np.uint64) & np.uint64(1)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in hit], pa.binary()), pa.array([squeeze.compress(raw[i]) for i in hit], pa.binary())],
                names=["text_key", "packed"],
            )

    return documents.mapInArrow(run, "text_key binary, packed binary")


def _shared_counts(owner: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """(n, n) numbers of common shingles of n sets, given as (owner, shingle) without repeats."""
    order = np.argsort(grams, kind="stable")
    owner, grams = owner[order], grams[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    out = np.zeros((n, n), dtype=np.float32)
    width = max(64, (1 << 22) // max(1, n))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s = slice(np.searchsorted(column, a), np.searchsorted(column, a + width))
        present = np.zeros((n, width), dtype=np.float32)
        present[owner[s], column[s] - a] = 1
        out += present @ present.T
    return out


def compare_block(
    reps: np.ndarray, weights: np.ndarray, block: np.ndarray, texts: list[bytes], threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the documents of one block among themselves, or of two blocks with each other.

    Returns per document the weight of the documents linked to it and the smallest id it reaches.
    """
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    part = words_of(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
    grams, ends = shingles(part)
    n = len(texts)
    sets = [np.unique(grams[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    size = np.array([len(s) for s in sets])
    common = _shared_counts(np.repeat(np.arange(n), size), np.concatenate(sets), n)
    linked = common / np.maximum(size[:, None] + size[None, :] - common.astype(np.float64), 1) >= threshold
    np.fill_diagonal(linked, False)
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    root = reps.copy()
    none = np.iinfo(np.int64).max
    while True:
        step = np.minimum(root, np.where(linked, root[None, :], none).min(axis=1, initial=none))
        if (step == root).all():
            return reps, (linked @ weights).astype(np.int64), root
        root = step


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """``rep, links, root`` from ``members (task, rep, weight, block, packed)`` sorted by task."""
    names = ["rep", "links", "root"]

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        task, rows = None, []

        def close() -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            rep, weight, block, packed = zip(*rows)
            found = compare_block(
                np.array(rep), np.array(weight), np.array(block), [open_.decompress(p) for p in packed], threshold
            )
            keep = found[1] > 0
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in found], names=names)

        for batch in batches:
            for t, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if t != task:
                    if (out := close()) is not None:
                        yield out
                    task, rows = t, []
                rows.append(row)
        if (out := close()) is not None:
            yield out

    return members.mapInArrow(run, "rep long, links long, root long")


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
    trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: ``<key>, class_id, n_links, component_id, kept``.

    Two documents link if the Jaccard similarity of their sets of five-word shingles is ``threshold``
    or more (at least 0.8).  ``class_id`` is the smallest key with the same set, ``n_links`` the number
    of other rows linked directly, copies included, ``component_id`` the smallest key reachable.
    Texts of fewer than five words have one shingle, all their words; null texts and texts without
    words link with nothing.  Rows with a null key link with nothing and are not ``kept``.  Repeated
    rows count one by one; a key with several texts stands for all of them.  An empty table gives an
    empty result; other columns are ignored.
    """
    if threshold < 1 / BAND:
        raise ValueError("sets are compared across neighbouring size bands only")
    docs = documents.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = stored(_signed(docs.where("id is not null"), trees, depth), "signatures")
    classes = stored(
        signed.groupBy("set_key").agg(
            F.min("id").alias("rep"), F.count("*").alias("weight"), F.min("text_key").alias("text_key"),
            F.first("n").alias("n"), F.first("labels").alias("labels"),
        ),
        "classes",
    )
    release(documents.sparkSession)
    cut = 8 * (depth - prefix_length(threshold, trees, depth, recall))
    nodes = classes.select("rep", F.posexplode("labels").alias("tree", "label")).select(
        "rep", F.xxhash64("tree", F.shiftrightunsigned("label", cut)).alias("node")
    )
    shared = nodes.groupBy("node").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    links = nodes.join(shared, "node").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    clusters = stored(connected_components(links), "clusters")
    release(documents.sparkSession)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")
    members = stored(
        classes.join(clusters, F.col("rep") == F.col("node"))
        .select("component", "rep", "weight", "text_key", band.alias("band")),
        "members",
    )
    sizes = members.groupBy("component", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    above = sizes.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("up"))
    below = sizes.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("down"))
    sized = sizes.join(above, ["component", "band"], "left").join(below, ["component", "band"], "left")
    sub = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")

    def tasks(which, count, first, second):
        """Tasks of a row with each block of a band: the lower (band, block) of a pair comes first."""
        made = F.transform(
            F.sequence(F.lit(1), count), lambda t: F.struct(first(t - 1).alias("i"), second(t - 1).alias("j"), which.alias("b"))
        )
        return F.when(count > 0, made).otherwise(F.array().cast("array<struct<i:int,j:int,b:int>>"))

    up, down = F.coalesce("up", F.lit(0)), F.coalesce("down", F.lit(0))
    all_tasks = F.concat(
        tasks(F.col("band") * 2, F.col("blocks"), lambda t: F.least(F.col("sub"), t), lambda t: F.greatest(F.col("sub"), t)),
        tasks(F.col("band") * 2 + 1, up, lambda t: F.col("sub"), lambda t: t),
        tasks(F.col("band") * 2 - 1, down, lambda t: t, lambda t: F.col("sub")),
    )
    dealt = (
        members.join(sized, ["component", "band"])
        .withColumn("sub", sub)
        .withColumn("task", F.explode(all_tasks))
        .select(
            "text_key", F.xxhash64("component", "task").alias("task"), "rep", "weight",
            (F.col("band") * 1000003 + F.col("sub")).alias("block"),
        )
    )
    bits = documents.sparkSession.sparkContext.broadcast(_key_bits(members))
    bodies = _packed(docs.where("id is not null").select("text"), bits).join(
        members.select("text_key").distinct(), "text_key", "left_semi"
    ).groupBy("text_key").agg(F.first("packed").alias("packed"))
    ordered = (
        dealt.join(bodies, "text_key").select("task", "rep", "weight", "block", "packed")
        .repartition(shuffle_partitions(documents.sparkSession), "task").sortWithinPartitions("task", "rep")
    )
    found = stored(_verified(ordered, threshold), "links")
    release(documents.sparkSession)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    judged = (
        classes.select("set_key", "rep", "weight")
        .join(counts, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
    )
    linked = signed.select("id", "set_key").join(judged, "set_key").select(
        "id", F.col("rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    # A key with several texts has a row for each; rows find theirs by key, once.
    by_id = linked.groupBy("id").agg(
        F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    return docs.select("id").join(by_id, "id", "left").select(
        F.col("id").alias(key),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
