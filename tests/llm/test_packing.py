import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fleetlens.llm.packing import CAPACITY, ROUNDS, _priced, knapsack, pack_documents, pack_histogram, solve_program
from fleetlens.llm.queries import QUERIES, TOKENIZER

from tests.llm.helpers import messy_documents

PATH = public_tokenizers.path(TOKENIZER)


def _sound(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def _cut(docs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            want[(r["doc_id"], piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    return want


def test_pieces_and_places_of_awkward_rows(spark):
    docs = messy_documents(spark)
    for capacity in (64, CAPACITY):
        rows = pack_documents(docs, PATH, capacity=capacity).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == _cut(docs, capacity)
        used = _sound(rows, capacity)
        plain = pack_histogram(Counter(r["length"] for r in rows), capacity, rounds=0)
        assert used <= (plain["sequence"] + plain["times"]).max()
    kept = pack_documents(docs, PATH, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in kept)
    assert pack_documents(docs.limit(0), PATH).count() == 0


def _fewest(lengths, capacity):
    """Exact minimum by search over sorted pieces."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for room in set(bins):
            if room >= lengths[i]:
                j = bins.index(room)
                place(i + 1, [*bins[:j], room - lengths[i], *bins[j + 1 :]])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return best


def test_small_histograms_against_exact_search():
    rng = np.random.default_rng(2)
    over = 0
    for _ in range(25):
        lengths = rng.integers(1, 21, 9).tolist()
        slots = pack_histogram(Counter(lengths), capacity=20)
        assert sum(slots["times"] * slots["each"]) == len(lengths)
        over += (slots["sequence"] + slots["times"]).max() - _fewest(lengths, 20)
    assert 0 <= over <= 2


def test_slots_are_disjoint_and_ties_fill_up():
    slots = pack_histogram({10: 1_000_000, 7: 3, 20: 5}, capacity=20)
    assert (slots["sequence"] + slots["times"]).max() == 500_000 + 5 + 2
    assert pack_histogram({}, capacity=20).empty


def test_knapsack_picks_the_most_valuable_fill():
    assert knapsack(np.array([3, 5]), np.array([3.0, 5.0]), 11) == {3: 2, 5: 1}


def test_query(spark, sf):
    rows = QUERIES["op4_best_fit_packing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == _cut(docs, CAPACITY)
    assert _sound(rows, CAPACITY) <= -(-sum(r["length"] for r in rows) // CAPACITY) + 1


def test_program_is_solved_to_its_gap_and_gives_most_sequences():
    rng = np.random.default_rng(7)
    lengths = Counter(np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, CAPACITY - 1).tolist())
    sizes, demand = np.array([60, 110, 130, 200, 260, 410]), np.array([900.0, 50, 700, 340, 1000, 77])
    times, bound = solve_program(sizes, demand, 512, 2000)
    cover = np.zeros(len(sizes))
    for pattern, x in times.items():
        assert sum(sizes[i] * n for i, n in pattern) <= 512
        for i, n in pattern:
            cover[i] += n * x
    assert (cover >= demand * (1 - 1e-9)).all()
    assert max(bound, sizes @ demand / 512) <= sum(times.values()) <= 1.02 * bound * (1 + 1e-9)
    left = dict(lengths)
    opened = sum(n for _, n in _priced(left, CAPACITY, ROUNDS))
    slots = pack_histogram(lengths)
    used = (slots["sequence"] + slots["times"]).max()
    assert opened > 0.8 * used and used <= -(-sum(x * n for x, n in lengths.items()) // CAPACITY) + 1
    assert Counter(dict((slots["times"] * slots["each"]).groupby(slots["length"]).sum())) == lengths
