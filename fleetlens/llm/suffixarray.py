"""Suffix-array dedup: bytes covered by a repeated string of at least ``length`` bytes are removed.

* Every window of ``length`` bytes holds one *anchor*, its run of ``ANCHOR`` bytes with the smallest hash
  (the leftmost of equal ones).  Equal windows have equal anchors at the same place, so windows whose
  anchor occurs once in the corpus are unique; they are discarded before any text moves.
* Adjacent windows with one anchor travel as one *run* of bytes.  Equal runs are summed first, so
  copies cost a digest each from there on.
* The distinct runs, ordered by anchor, are cut into *shards*: small anchors share one up to about
  ``JOINED_BYTES``, larger ones have their own of up to ``SHARD_BYTES``.  A shard gets a suffix array (Larsson-Sadakane: groups of equal prefixes are refined by the ranks of the suffixes
  behind them, which doubles the sorted depth each time) and its common prefixes (Kasai's bound: a
  prefix shared with the neighbour in the array is at most one byte shorter one position on).
  Windows that share ``length`` bytes with a neighbour are repeats.
* An anchor with more bytes than a shard holds is spread over several.  Their suffix arrays are merged
  across shards: regular samples of all of them give splitters, every shard finds the splitters in its
  array by binary search, and the pieces between two splitters meet in one task, which looks each up in
  the others by binary search.

Matches never cross texts: runs are separated by a symbol that no byte has.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.storage import release, shuffle_partitions, stored
from fleetlens.llm.wordbatch import mix, ranges, string_buffers

LENGTH = 400
ANCHOR = 48
SHARD_BYTES = 1 << 20  #: bytes of the runs of a shard
JOINED_BYTES = 1 << 15  #: smaller anchors share a shard up to so many bytes; its arrays stay in a core's cache
PIECE_WINDOWS = 1 << 16  #: windows between two splitters, about
SAMPLES = 16  #: samples of a shard per piece
SLICE_BYTES = 1 << 18  #: texts are scanned in slices of about so many bytes

_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)


# --- anchors -----------------------------------------------------------------------------------


def _byte_grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` adjacent bytes, by doubling: a hash of 2h bytes joins two of h bytes."""
    out, have = _BYTE_VALUE[data], 1
    while have < size:
        step = min(have, size - have)
        # The two halves may overlap; the join stays a function of the bytes alone.
        out = out[:-step] * np.uint64(pow(_BASE, have, 2**64)) + out[step:]
        have += step
    return mix(out)


@dataclass
class Runs:
    """Adjacent windows with the same anchor."""

    start: np.ndarray  #: first byte of the first window
    windows: np.ndarray
    anchor: np.ndarray  #: hash of the anchor


def anchor_runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> Runs:
    """The runs of texts that lie in ``data`` between ``bounds``."""
    none = np.zeros(0, dtype=np.int64)
    size = np.diff(bounds)
    starts, counts = bounds[:-1][size >= length], size[size >= length] - length + 1
    if not len(starts):
        return Runs(none, none, none.astype(np.uint64))
    best = _byte_grams(data, ANCHOR)
    at, have, span = np.arange(len(best), dtype=np.int32), 1, length - ANCHOR + 1
    while have < span:
        step = min(have, span - have)
        take = best[step:] < best[:-step]
        at = np.where(take, at[step:], at[:-step])
        best = np.minimum(best[:-step], best[step:])
        have += step
    windows = ranges(starts, counts)
    place = at[windows]
    new = np.ones(len(windows), dtype=bool)
    # Anchors lie inside a text, so windows of different texts never share one.
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    return Runs(windows[first], np.diff(np.append(first, len(windows))), best[windows[first]])


def _per_text(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text with a window: its number, and start (in the text), windows and anchor of its runs."""
    runs = anchor_runs(data, bounds, length)
    owner = np.searchsorted(bounds, runs.start, side="right") - 1
    cut = np.searchsorted(owner, np.arange(len(bounds)))
    for t in np.unique(owner).tolist():
        s = slice(cut[t], cut[t + 1])
        yield t, runs.start[s] - bounds[t], runs.windows[s], runs.anchor[s].view(np.int64)


def _text_anchors(texts: DataFrame, length: int) -> DataFrame:
    """``key, anchors`` of every text with a window; an anchor at several places of a text comes twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = string_buffers(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1))
                rows, lists, ends = [], [np.zeros(0, dtype=np.int64)], [0]
                for t, _, _, anchor in _per_text(data[at[i] : at[j]], at[i : j + 1] - at[i], length):
                    once, times = np.unique(anchor, return_counts=True)
                    lists += [once, once[times > 1]]
                    rows.append(i + t)
                    ends.append(ends[-1] + len(once) + len(lists[-1]))
                if rows:
                    anchors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), anchors], names=["key", "anchors"])
                i = j

    return texts.mapInArrow(run, "key binary, anchors array<long>")


_RUN_COLUMNS = "anchor long, id binary, run binary, windows int, firsts array<long>, key binary, rows long"


def _shared_runs(carriers: DataFrame, length: int) -> DataFrame:
    """Runs of ``carriers (key, packed, wanted, rows)`` with a wanted anchor, equal runs of a text as one row.

    The bytes of a run come with its first row in a task only; ``id`` is their digest.
    """
    names = [c.split()[0] for c in _RUN_COLUMNS.split(", ")]
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        seen: set[bytes] = set()
        for batch in batches:
            keys, packed, rows = (batch.column(i).to_pylist() for i in (0, 1, 3))
            at = 0
            while at < len(packed):
                raw, stop, size = [], at, 0
                while stop < len(packed) and size < SLICE_BYTES:
                    raw.append(open_.decompress(packed[stop]))
                    size += len(raw[-1])
                    stop += 1
                body = b"".join(raw)
                bounds = np.cumsum([0, *map(len, raw)])
                out: list[list] = [[] for _ in names]
                for t, start, windows, anchor in _per_text(np.frombuffer(body, dtype=np.uint8), bounds, length):
                    shared = np.isin(anchor, batch.column(2)[at + t].values.to_numpy())
                    found: dict[bytes, list] = {}
                    for a, n, h in zip(start[shared].tolist(), windows[shared].tolist(), anchor[shared].tolist()):
                        piece = body[bounds[t] + a : bounds[t] + a + n + length - 1]
                        digest = hashlib.md5(piece).digest()
                        if digest in found:
                            found[digest][4].append(a)
                        else:
                            found[digest] = [h, digest, None if digest in seen else piece, n, [a], keys[at + t], rows[at + t]]
                            seen.add(digest)
                    for values in found.values():
                        for column, value in zip(out, values):
                            column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)
                if len(seen) > 1 << 20:
                    seen.clear()
                at = stop

    return carriers.mapInArrow(run, _RUN_COLUMNS)


# --- suffix arrays -----------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` (0 to 256), by Larsson-Sadakane refinement."""
    n = len(symbols)
    wide = np.zeros(n + 8, dtype=np.int64)
    wide[:n] = symbols + 1
    depth, key = 7, np.zeros(n, dtype=np.int64)
    for i in range(depth):
        key = (key << 9) | wide[i : i + n]
    order = np.argsort(key)
    new = np.ones(n, dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    #: Rank of a suffix: the place of the first of its group; suffixes beyond the end come before all.
    rank = np.zeros(n + 1, dtype=np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first + 1
    # Only members of groups of two and more are looked at again.
    open_ = np.flatnonzero(~new | ~np.append(new[1:], True))
    while len(open_):
        suffix = order[open_]
        group = rank[suffix]
        behind = rank[np.minimum(suffix + depth, n)]
        key = group * np.int64(n + 1) + behind
        by = np.argsort(key)
        order[open_] = suffix[by]
        key = key[by]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        # Equal keys stay one group, named after the place of its first member.
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[suffix[by]] = open_[head] + 1
        open_ = open_[~new | ~np.append(new[1:], True)]
        depth *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols shared by each suffix in ``order`` and the one before it.

    Where the symbols in front of two neighbours agree, the prefix is exactly one shorter than that of
    the position before (Kasai); only the other positions are compared, eight bytes at a time.
    """
    n = len(symbols)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(1, n)
    carried = np.zeros(n, dtype=bool)
    carried[1:] = (before[1:] > 0) & (symbols[at - 1] == symbols[np.maximum(before[1:], 1) - 1])
    # A carried position needs its predecessor's neighbour to be the one in front of its own.
    carried[1:] &= before[:-1] == before[1:] - 1
    fresh = np.flatnonzero(~carried & (before >= 0))
    step = 4
    words = np.zeros(n + step, dtype=np.uint64)
    wide = np.zeros(n + step, dtype=np.uint64)
    wide[:n] = symbols + 1
    for i in range(step):
        words[:n] = (words[:n] << np.uint64(16)) | wide[i : i + n]
    length = np.zeros(n, dtype=np.int64)
    live, shift = fresh, np.zeros(len(fresh), dtype=np.int64)
    while len(live):
        a, b = live + shift, before[live] + shift
        inside = (a < n) & (b < n)
        same = inside & (words[np.minimum(a, n)] == words[np.minimum(b, n)])
        length[live] = shift
        live, shift = live[same], shift[same] + step
    # The last, partial step.
    a, b = fresh + length[fresh], before[fresh] + length[fresh]
    for _ in range(step):
        same = (a < n) & (b < n)
        same[same] = symbols[a[same]] == symbols[b[same]]
        length[fresh[same]] += 1
        fresh, a, b = fresh[same], a[same] + 1, b[same] + 1
        if not len(fresh):
            break
    source = np.maximum.accumulate(np.where(carried, 0, np.arange(n)))
    length = np.where(carried, length[source] - (np.arange(n) - source), length)
    return np.maximum(length, 0)[order]


@dataclass
class Shard:
    """Suffix array of some runs, reduced to the suffixes that are windows."""

    data: bytes
    window: np.ndarray  #: windows in suffix order: first byte in ``data``
    new: np.ndarray  #: differs from the window before it
    repeated: np.ndarray  #: equals a neighbour, or belongs to a run with copies
    run: np.ndarray  #: number of the run
    place: np.ndarray  #: number of the window in its run


def index_shard(runs: list[bytes], copies: list[int], length: int) -> Shard:
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    data = b"\0".join(runs) + b"\0"
    symbols = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
    symbols[begin + sizes] = 0
    order = suffix_array(symbols)
    shared = common_prefixes(symbols, order)
    run_of = np.repeat(np.arange(len(runs)), sizes + 1)
    place = np.arange(len(symbols)) - begin[run_of]
    valid = place + length <= sizes[run_of]
    # Windows with an equal prefix of this length are adjacent among all suffixes, valid or not.
    same = shared >= length
    window = order[valid[order]]
    new = ~same[valid[order]]
    owner = run_of[window]
    class_of = np.cumsum(new) - 1
    often = np.array(copies, dtype=np.int64)[owner] > 1
    members = np.bincount(class_of)
    any_often = np.bincount(class_of, weights=often) > 0
    repeated = (members[class_of] > 1) | any_often[class_of]
    return Shard(data, window, new, repeated, owner, place[window])


def _spans(run: np.ndarray, place: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Maximal stretches of places per run (end exclusive)."""
    if not len(run):
        return {}
    by = np.lexsort((place, run))
    run, place = run[by], place[by]
    cut = np.ones(len(run), dtype=bool)
    cut[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(run)) - 1
    out: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(run[first].tolist(), place[first].tolist(), (place[last] + 1).tolist()):
        out.setdefault(r, []).append((a, b))
    return out


def _shards(batches: Iterator[pa.RecordBatch], length: int, limit: int) -> Iterator[tuple[str, list[bytes], list, Shard]]:
    """Shards of ``shard, id, run, copies`` and further columns, which come sorted by shard.

    Whole anchors join until there are ``limit`` or ``JOINED_BYTES`` bytes; the shards of a large anchor stay apart.
    Values of a fifth column are handed on, nulls left out.
    """
    limit = min(limit, JOINED_BYTES)
    names, ids, runs, copies, more, size = [], [], [], [], [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if names and row[0] != names[-1] and (size >= limit or names[-1].startswith("+")):
                yield names[-1], ids, more, index_shard(runs, copies, length)
                names, ids, runs, copies, more, size = [], [], [], [], [], 0
            names.append(row[0])
            ids.append(row[1])
            runs.append(row[2])
            copies.append(row[3])
            more += [v for v in row[4:] if v is not None]
            size += len(row[2])
    if runs:
        yield names[-1], ids, more, index_shard(runs, copies, length)


_SPAN_KIND = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SPAN_TYPE = "array<struct<a: int, b: int>>"


def _repeats(shards: DataFrame, length: int, limit: int) -> DataFrame:
    """``id, spans``: places of the windows of a run that repeat in its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, _, shard in _shards(batches, length, limit):
            spans = _spans(shard.run[shard.repeated], shard.place[shard.repeated])
            if spans:
                found = pa.array([[{"a": a, "b": b} for a, b in s] for s in spans.values()], _SPAN_KIND)
                yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in spans], pa.binary()), found], names=["id", "spans"])

    return shards.mapInArrow(run, f"id binary, spans {_SPAN_TYPE}")


# --- merging across the shards of one anchor ----------------------------------------------------


def _samples(shards: DataFrame, length: int, limit: int, piece: int) -> DataFrame:
    """``anchor, window``: every so many-th window of each shard, in suffix order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, shard in _shards(batches, length, limit):
            step = max(1, piece // SAMPLES)
            taken = [shard.data[w : w + length] for w in shard.window[step - 1 :: step].tolist()]
            if taken:
                anchor = int(name.split(":")[1])
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * len(taken)), pa.array(taken, pa.binary())], names=["anchor", "window"])

    return shards.mapInArrow(run, "anchor long, window binary")


class _Windows:
    """Windows of a shard in suffix order, as a sequence to search in."""

    def __init__(self, data: bytes, starts: np.ndarray, length: int):
        self._data, self._starts, self._length = data, starts, length

    def __len__(self) -> int:
        return len(self._starts)

    def __getitem__(self, i: int) -> bytes:
        return self._data[self._starts[i] : self._starts[i] + self._length]


def _pieces(shards: DataFrame, length: int, limit: int) -> DataFrame:
    """``anchor, piece, ids, counts, runs, places, windows``: the windows of a shard between two splitters.

    Equal windows of a shard come once; ``counts`` says for how many ``runs`` (numbers in ``ids``) and ``places``.
    """
    names = ["anchor", "piece", "ids", "counts", "runs", "places", "windows"]
    ints = pa.list_(pa.int32())
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.binary()), ints, ints, ints, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for name, ids, splitters, shard in _shards(batches, length, limit):
            bounds = sorted(s for found in splitters for s in found)[SAMPLES - 1 :: SAMPLES]
            heads = np.flatnonzero(shard.new)
            ends = np.append(heads[1:], len(shard.new))
            windows = _Windows(shard.data, shard.window[heads], length)
            cuts = [0, *[bisect.bisect_right(windows, s) for s in bounds], len(windows)]
            for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a == b:
                    continue
                inside = slice(heads[a], ends[b - 1])
                used, runs = np.unique(shard.run[inside], return_inverse=True)
                values = (
                    int(name.split(":")[1]), piece, [ids[r] for r in used.tolist()], (ends[a:b] - heads[a:b]).tolist(), runs.tolist(),
                    shard.place[inside].tolist(), pack.compress(b"".join([windows[i] for i in range(a, b)])),
                )
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    return shards.mapInArrow(
        run, "anchor long, piece int, ids array<binary>, counts array<int>, runs array<int>, places array<int>, windows binary"
    )


def merge_sorted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted arrays of distinct strings with their counts as one; places are found by binary search."""
    at = np.searchsorted(a[0], b[0])
    both = np.zeros(len(at), dtype=bool)
    near = at < len(a[0])
    both[near] = a[0][at[near]] == b[0][near]
    seen = a[1].copy()
    seen[at[both]] += b[1][both]
    return np.insert(a[0], at[~both], b[0][~both]), np.insert(seen, at[~both], b[1][~both])


def _merge(pieces: DataFrame, length: int) -> DataFrame:
    """``id, spans`` of windows that occur in several shards; ``pieces`` come sorted by anchor and piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()

        def emit(group: list[dict]) -> Iterator[pa.RecordBatch]:
            if len(group) < 2:
                return
            arrays = [np.frombuffer(open_.decompress(p["windows"]), dtype=f"S{length}") for p in group]
            merged = [(a, np.ones(len(a), dtype=np.int32)) for a in arrays]
            while len(merged) > 1:
                merged = [merge_sorted(*pair) if len(pair) == 2 else pair[0] for pair in (merged[i : i + 2] for i in range(0, len(merged), 2))]
            windows, seen = merged[0]
            for p, array in zip(group, arrays):
                often = np.repeat(seen[np.searchsorted(windows, array)] > 1, p["counts"])
                if often.any():
                    spans = _spans(np.array(p["runs"])[often], np.array(p["places"])[often])
                    found = pa.array([[{"a": a, "b": b} for a, b in s] for s in spans.values()], _SPAN_KIND)
                    yield pa.RecordBatch.from_arrays([pa.array([p["ids"][r] for r in spans], pa.binary()), found], names=["id", "spans"])

        group: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                piece = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if group and (piece["anchor"], piece["piece"]) != (group[0]["anchor"], group[0]["piece"]):
                    yield from emit(group)
                    group = []
                group.append(piece)
        yield from emit(group)

    return pieces.mapInArrow(run, f"id binary, spans {_SPAN_TYPE}")


def repeated_windows(distinct: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, piece: int = PIECE_WINDOWS) -> DataFrame:
    """``id, spans`` of the distinct runs ``(anchor, id, run, windows, copies)`` that hold a repeated window."""
    spark = distinct.sparkSession
    sizes = distinct.groupBy("anchor").agg(F.sum(F.octet_length("run")).alias("size"))
    large = stored(sizes.where(F.col("size") > shard_bytes), "large-anchors")
    name = F.col("anchor").cast("string")
    small = distinct.join(large, "anchor", "left_anti").select(F.concat(F.lit("-:"), name).alias("shard"), "anchor", "id", "run", "copies")
    # Runs of a large anchor are dealt to its shards by their digest.
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / shard_bytes))
    spread = distinct.join(large, "anchor").select(F.concat(F.lit("+:"), name, F.lit(":"), salt.cast("string")).alias("shard"), "anchor", "id", "run", "copies")
    n = shuffle_partitions(spark)

    def in_order(runs: DataFrame, *more: str) -> DataFrame:
        return runs.select("shard", "id", "run", "copies", *more).repartition(n, "shard").sortWithinPartitions("shard", "run")

    found = _repeats(in_order(small.unionByName(spread)), length, shard_bytes)
    if large.isEmpty():
        return found
    spread = stored(spread, "large-runs")
    samples = stored(_samples(in_order(spread), length, shard_bytes, piece), "samples")
    splitters = samples.groupBy("anchor").agg(F.collect_list("window").alias("splitters"))
    # Splitters come with one run of each shard only.
    heads = spread.groupBy("shard").agg(F.min("run").alias("run"), F.first("anchor").alias("anchor"))
    with_splitters = spread.join(heads.join(splitters, "anchor").select("shard", "run", "splitters"), ["shard", "run"], "left")
    pieces = stored(_pieces(in_order(with_splitters, "splitters"), length, shard_bytes), "pieces")
    together = pieces.repartition(n, "anchor", "piece").sortWithinPartitions("anchor", "piece")
    return found.unionByName(_merge(together, length))


# --- whole texts --------------------------------------------------------------------------------


def _packed(frame: DataFrame) -> DataFrame:
    """Compress the last column, a string, into a binary ``packed``."""
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            *others, text = batch.columns
            packed = pa.array([squeeze.compress(t.encode()) for t in text.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*others, packed], names=schema.names)

    return frame.mapInArrow(run, schema)


def _cut(frame: DataFrame, length: int) -> DataFrame:
    """``rest, n_bytes, n_removed, n_spans, kept, removed`` from ``rest, packed, whole, found``."""
    schema = T.StructType(
        [
            frame.schema.fields[0], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
            T.StructField("kept", T.BinaryType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, kept, removed = [], [], []
            for raw, whole, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                body = open_.decompress(raw)
                sizes.append(len(body))
                if whole and len(body) >= length:
                    stretches = [[0, len(body)]]
                elif found.is_valid:
                    edge = np.zeros(len(body) + 1, dtype=np.int64)
                    for x in found.as_py():
                        first = np.array(x["firsts"])
                        for s in x["spans"]:
                            np.add.at(edge, first + s["a"], 1)
                            np.add.at(edge, first + s["b"] + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    stretches = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                else:
                    stretches = []
                removed.append(stretches)
                ends = [0, *[e for s in stretches for e in s], len(body)]
                kept.append(b"".join([body[a:b] for a, b in zip(ends[0::2], ends[1::2])]))
            values = [
                pa.array(sizes, pa.int64()), pa.array([sum(b - a for a, b in s) for s in removed], pa.int64()),
                pa.array([len(s) for s in removed], pa.int64()), pa.array(kept, pa.binary()),
                pa.array(removed, pa.list_(pa.list_(pa.int64()))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], names=schema.names)

    return frame.mapInArrow(run, schema)


def remove_repeated_bytes(
    documents: DataFrame, length: int = LENGTH, text: str = "text", shard_bytes: int = SHARD_BYTES, piece: int = PIECE_WINDOWS
) -> DataFrame:
    """Add ``n_bytes, n_removed, n_spans, kept`` (binary) and ``removed`` (byte spans, end exclusive); drop ``text``.

    Texts are taken as UTF-8 bytes, null as empty; cuts may fall inside a character.  A byte is removed
    if a string of ``length`` bytes that covers it starts anywhere else too, in the same text included;
    strings are judged on the input and never cross texts.  Repeated rows are places of their own,
    whatever their other columns hold.  Columns of those five names are replaced, others keep their
    values.  An empty table gives an empty result.
    """
    if length <= ANCHOR:
        raise ValueError(f"strings must be longer than {ANCHOR} bytes")
    own = ("n_bytes", "n_removed", "n_spans", "kept", "removed")
    kept = [c for c in documents.columns if c not in own and c != text]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    filler = "_" * (1 + max(map(len, kept), default=0))  # a struct needs a field, also where no other column is kept
    rest = F.struct(F.lit(0).alias(filler), *[F.col(f"`{c}`") for c in kept])
    docs = documents.select(rest.alias("rest"), F.unhex(F.md5(body.cast("binary"))).alias("key"), body.alias("text"))
    # One row per distinct text: how many rows hold it, and its anchors.
    texts = stored(
        _text_anchors(docs.select("key", "text"), length).groupBy("key").agg(F.count("*").alias("rows"), F.first("anchors").alias("anchors")),
        "byte-anchors",
    )
    places = texts.select("key", F.explode("anchors").alias("anchor"))
    twice = places.groupBy("anchor").count().where("count > 1").select("anchor")
    wanted = stored(places.join(twice, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("wanted")), "byte-wanted")
    release(documents.sparkSession)
    carriers = texts.select("key", "rows").join(wanted, "key")
    packed = _packed(docs.select("key", "text")).groupBy("key").agg(F.first("packed").alias("packed"))
    runs = stored(_shared_runs(packed.join(carriers, "key").select("key", "packed", "wanted", "rows"), length), "byte-runs")
    release(documents.sparkSession)
    distinct = stored(
        runs.groupBy("anchor", "id").agg(F.max("run").alias("run"), F.sum(F.col("rows") * F.size("firsts")).alias("copies")),
        "byte-distinct",
    )
    spans = repeated_windows(distinct, length, shard_bytes, piece).groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    found = runs.select("id", "key", "firsts").join(spans, "id").groupBy("key").agg(F.collect_list(F.struct("firsts", "spans")).alias("found"))
    verdicts = stored(texts.where("rows > 1").select("key", F.lit(True).alias("whole")).join(found, "key", "full"), "byte-verdicts")
    release(documents.sparkSession)
    judged = _packed(docs).join(verdicts, "key", "left").select("rest", "packed", F.coalesce("whole", F.lit(False)).alias("whole"), "found")
    return _cut(judged, length).select(*[F.col(f"rest.`{c}`").alias(c) for c in kept], *own)
