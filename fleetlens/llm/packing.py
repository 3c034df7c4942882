"""Best-fit packing of token sequences: a configuration program over the length histogram.

Only the histogram reaches the driver, at most ``capacity`` numbers whatever the corpus holds.  Long
pieces form classes of about equal counts, each as large as its longest piece.  The configuration
program (patterns say how many pieces of each class share a sequence) is solved by multiplicative
weights, with an unbounded knapsack that prices the patterns, to a fractional solution near its lower
bound.  That is rounded down, and best fit, longest first, places the rest and all short pieces, into
the room of those sequences or new ones, still by counts.  Every piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.bpe import encode_column
from fleetlens.llm.memory import sparing
from fleetlens.llm.storage import stored

CAPACITY = 4096
END_ID = 1
ROUNDS = 2000  #: knapsacks priced at most
GAP = 0.02  #: between the program's fractional solution and its lower bound
RATE = 0.2  #: step of the multiplicative update
CLASSES = 64  #: sizes that the program tells apart
GRAINS = 512  #: parts of the capacity that it counts in
FREE = 0.8  #: share of the space that short pieces take which the program leaves to them in its sequences
SHORT = 8  #: pieces under this part of the capacity close gaps
SALTS = 256  #: parts that the pieces of one length are ranked in


@dataclass(frozen=True)
class Bins:
    """``count`` sequences that hold ``each`` pieces of ``length`` on top of those of ``below``."""

    below: Bins | None
    length: int
    each: int
    used: int


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset of lengths (ascending) that fits: length -> count."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = fitting[c]
        gain = best[c - lengths[:k]] + values[:k]
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], pick[c] = gain[i], i
        else:
            best[c], pick[c] = best[c - 1], -1
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        length = int(lengths[pick[c]])
        out[length] = out.get(length, 0) + 1
        c -= length
    return out


def solve_program(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int, gap: float = GAP) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Fewest sequences that cover ``demand`` pieces of each size (ascending), as a fractional solution.

    Returns how often each pattern, pairs of a size's number and a count, is taken, and a lower bound.
    Multiplicative weights against the full demand: a round prices one pattern by a knapsack and takes
    it until one of its sizes is covered once more; the weight of a size falls with its coverage.  The
    sum of the rounds over the least coverage is feasible, the weights over the best value solve the
    dual.  Ends when both are within ``gap``.
    """
    number = {x: i for i, x in enumerate(sizes.tolist())}
    covered = np.zeros(len(sizes))
    times: dict[tuple[tuple[int, int], ...], float] = {}
    taken, bound, least = 0.0, float(sizes @ demand) / room, 0.0
    for _ in range(rounds):
        # At first a size weighs what it takes of the room.
        weight = demand * sizes * np.exp(-RATE * (covered - least))
        value = weight / demand
        held = knapsack(sizes, value, room)
        pattern = tuple((number[x], n) for x, n in sorted(held.items(), reverse=True))
        at, n = np.array(pattern).T
        bound = max(bound, float(weight.sum() / (value[at] @ n)))
        step = float((demand[at] / n).min())
        times[pattern] = times.get(pattern, 0.0) + step
        covered[at] += step * n / demand[at]
        taken += step
        least = float(covered.min())
        if least and taken / least <= (1 + gap) * bound:
            break
    return ({k: x / least for k, x in times.items()} if least else {}), bound


def _classes(left: Mapping[int, int], capacity: int, grain: int, room: int) -> tuple[np.ndarray, list[list[list[int]]]]:
    """Long lengths in classes of about equally many pieces: sizes in grains (ascending), and [length, count] of each."""
    lengths = sorted((x for x, n in left.items() if n and x * SHORT >= capacity), reverse=True)
    total, before = sum(left[x] for x in lengths), 0
    classes: dict[int, list[list[int]]] = {}
    last = size = -1
    for x in lengths:
        number = before * CLASSES // total
        if number != last:
            last, size = number, min(-(-x // grain), room)  # a class is as large as its longest piece
        classes.setdefault(size, []).append([x, left[x]])
        before += left[x]
    sizes = sorted(classes)
    return np.array(sizes, dtype=np.int64), [classes[x] for x in sizes]


def _priced(left: dict[int, int], capacity: int, rounds: int) -> list[tuple[Bins, int]]:
    """Sequences of the program, rounded down; takes their pieces out of ``left``.

    The program knows the long pieces by class; short ones are left to close the gaps.
    """
    full = left.pop(capacity, 0)
    taken = [(Bins(None, capacity, 1, capacity), full)] if full else []
    grain = max(1, capacity // GRAINS)
    held = sum(x * n for x, n in left.items())
    if not rounds or not held:
        return taken
    # Every sequence keeps its part of the short pieces' space free.
    free = FREE * sum(x * n for x, n in left.items() if x * SHORT < capacity) / held
    room = max(1, int(capacity * (1 - free)) // grain)
    sizes, queues = _classes(left, capacity, grain, room)
    if not len(sizes):
        return taken
    times, _ = solve_program(sizes, np.array([sum(n for _, n in q) for q in queues], dtype=float), room, rounds)
    for pattern, x in sorted(times.items(), key=lambda item: -item[1]):
        open_ = min(int(x), *[sum(n for _, n in queues[i]) // each for i, each in pattern])
        while open_:
            # Equal sequences move together, until one of the lengths runs out.
            many = min(open_, *[queues[i][0][1] // each for i, each in pattern]) or 1
            bins = None
            for i, each in pattern:
                while each:
                    length, count = queues[i][0]
                    n = each if many > 1 else min(each, count)
                    bins = Bins(bins, length, n, (bins.used if bins else 0) + n * length)
                    left[length] -= many * n
                    queues[i][0][1] -= many * n
                    if not queues[i][0][1]:
                        queues[i].pop(0)
                    each -= n
            taken.append((bins, many))
            open_ -= many
    return taken


def _best_fit(left: dict[int, int], bins: list[tuple[Bins, int]], capacity: int) -> list[tuple[Bins, int]]:
    """Best fit, longest first, of all that is left; equal sequences move together."""
    room: dict[int, list[tuple[Bins | None, int]]] = {}
    order: list[int] = []

    def add(kind: Bins, count: int) -> None:
        space = capacity - kind.used
        if space not in room:
            room[space] = []
            bisect.insort(order, space)
        room[space].append((kind, count))

    for kind, count in bins:
        add(kind, count)
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        need = left[length]
        while need:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                space = order[at]
                kind, count = room[space].pop()
                if not room[space]:
                    del room[space]
                    order.pop(at)
            else:
                space, kind, count = capacity, None, need
            each = min(space // length, need)
            moved = min(count, need // each)
            if kind is not None and count > moved:
                add(kind, count - moved)
            add(Bins(kind, length, each, (kind.used if kind else 0) + each * length), moved)
            need -= moved * each
    return [(kind, count) for kinds in room.values() for kind, count in kinds]


def pack_histogram(histogram: Mapping[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> pd.DataFrame:
    """Slots for all pieces of a length histogram.

    One row per (pattern, length): pieces with ranks ``first .. first + times * each - 1`` of that
    length go to the sequences from ``sequence`` on, ``each`` to a sequence, from ``offset`` on.
    """
    left = {int(x): int(n) for x, n in histogram.items() if n}
    if any(x <= 0 or x > capacity for x in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    packed = _best_fit(left, _priced(left, capacity, rounds), capacity)
    rows, sequence, rank = [], 0, dict.fromkeys(map(int, histogram), 0)
    for kind, times in packed:
        while kind is not None:
            below = kind.below.used if kind.below else 0
            rows.append((kind.length, rank[kind.length], times, kind.each, sequence, below))
            rank[kind.length] += times * kind.each
            kind = kind.below
        sequence += times
    out = pd.DataFrame(rows, columns=["length", "first", "times", "each", "sequence", "offset"], dtype="int64")
    return out.sort_values(["length", "first"], ignore_index=True)


def cut_documents(
    documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    key: str = "doc_id", text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``<key>, piece, start, length, ids_crc32`` (and ``ids``)."""
    frame = documents.select(f"`{key}`", f"`{text}`")
    schema = documents.select(f"`{key}`").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, flat, bounds in encode_column(path, batch.column(1)):
                flat = np.insert(flat, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                total = np.diff(bounds)
                count = -(-total // capacity)
                owner = np.repeat(np.arange(len(total)), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, total[owner] - start)
                at = bounds[owner] + start
                columns = [
                    keys.take(pa.array(first + owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(flat[a : a + n]) for a, n in zip(at.tolist(), length.tolist())], pa.int64()),
                ]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema)


def pack_documents(
    documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    key: str = "doc_id", text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset`` in gapless sequences.

    Ids are those of the BPE file at ``path`` followed by ``end_id``.  Only documents longer than
    ``capacity`` are cut; their last piece may be shorter.  A null or empty text is the end id alone.
    Rows are packed one by one, so repeated rows and keys, and null keys, are packed as often as they
    occur.  An empty table gives no rows; other columns are ignored.
    """
    pieces = stored(cut_documents(documents, path, capacity, end_id, key, text, keep_ids), "pieces")
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = pack_histogram(histogram, capacity)
    salt = F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    salted = pieces.withColumn("_salt", salt)
    offsets = (
        salted.groupBy("length", "_salt").count()
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("count").over(
                    Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("count")
    )
    within = Window.partitionBy("length", "_salt").orderBy(key, "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_row", F.row_number().over(within) - 1)
        .join(offsets, ["length", "_salt"])
        .select(*pieces.columns, (F.col("_before") + F.col("_row")).alias("_rank"))
    )
    # The slots follow from the histogram, so their number is bounded too.
    table = documents.sparkSession.sparkContext.broadcast(slots)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @sparing
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.value
        keys = slots["length"].to_numpy() * (1 << 40) + slots["first"].to_numpy()
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            length = batch.column("length").to_numpy()
            row = np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1
            inside = rank - slots["first"].to_numpy()[row]
            each = slots["each"].to_numpy()[row]
            sequence = slots["sequence"].to_numpy()[row] + inside // each
            offset = slots["offset"].to_numpy()[row] + inside % each * length
            own = [c for name, c in zip(batch.schema.names, batch.columns) if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)
