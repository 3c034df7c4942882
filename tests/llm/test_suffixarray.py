import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm.queries import QUERIES
from fleetlens.llm.suffixarray import JOINED_BYTES, _shards, common_prefixes, index_shard, merge_sorted, remove_repeated_bytes, suffix_array

from tests.llm.helpers import messy_documents, messy_texts


def plain(texts, length):
    """(bytes, removed, spans, kept) per text by counting every window."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def _lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("letters", [1, 2, 4, 257])
def test_suffix_array_and_prefixes(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 9, 300):
        body = rng.integers(0, letters, n)
        if n == 300:
            body[200:280] = body[20:100]
        order = suffix_array(body)
        want = sorted(range(n), key=lambda i: body[i:].tolist())
        assert order.tolist() == want
        shared = common_prefixes(body, order).tolist()
        assert shared == [_lcp(body[want[i]:].tolist(), body[want[i - 1]:].tolist()) if i else 0 for i in range(n)]


def test_shard_finds_repeats_in_runs_and_between_them():
    runs = [b"abcdefgh", b"xxcdefyy", b"qqqqqqqq", b"zzzzzz\x00\xff"]
    shard = index_shard(runs, [1, 1, 1, 2], 4)
    found = {(runs[r][p : p + 4], r, p) for r, p in zip(shard.run[shard.repeated].tolist(), shard.place[shard.repeated].tolist())}
    want = Counter(r[i : i + 4] for r, n in zip(runs, [1, 1, 1, 2]) for i in range(len(r) - 3) for _ in range(n))
    assert found == {(r[i : i + 4], k, i) for k, r in enumerate(runs) for i in range(len(r) - 3) if want[r[i : i + 4]] > 1}


def test_merge_by_binary_search():
    a = (np.array([b"a", b"c", b"e"], dtype="S2"), np.array([1, 1, 1]))
    b = (np.array([b"a", b"b", b"e", b"f"], dtype="S2"), np.array([1, 2, 1, 1]))
    words, seen = merge_sorted(a, b)
    assert words.tolist() == [b"a", b"b", b"c", b"e", b"f"] and seen.tolist() == [2, 2, 1, 2, 1]


def _texts():
    rng = random.Random(5)
    letters = "abcdefghij é日\n\0"
    passage = "".join(rng.choice(letters) for _ in range(150))
    own = ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(60)]
    # The passage in many contexts, cut off on either side, alone, doubled and periodic.
    texts = [o[:k] + passage[rng.randrange(40) : 100 + rng.randrange(50)] + o[k:] for k, o in enumerate(own)]
    return texts + [passage, passage * 3, "ab" * 400, "a" * 700, "a" * 64, "a" * 63, own[1], own[1]] + messy_texts()[:20]


@pytest.mark.parametrize(("shard_bytes", "piece"), [(1 << 20, 1 << 16), (3000, 16), (300, 640)])
def test_against_plain_version(spark, shard_bytes, piece):
    texts = _texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = remove_repeated_bytes(frame, 64, shard_bytes=shard_bytes, piece=piece).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == dict(enumerate(plain(texts, 64)))
    assert all(sum(b - a for a, b in r["removed"]) == r["n_removed"] for r in got)


def test_awkward_tables(spark):
    docs = messy_documents(spark).selectExpr("*", "1 as n_bytes", "2 as rest", "3 as removed", "4 as whole", "5 as found", "6 as _")
    got = remove_repeated_bytes(docs, 100)
    rows = got.collect()
    texts = [r["text"] for r in docs.collect()]
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows) == Counter(plain(texts, 100))
    assert all((r["rest"], r["whole"], r["found"], r["_"]) == (2, 4, 5, 6) for r in rows)
    assert remove_repeated_bytes(docs.limit(0), 100).isEmpty()


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_suffix_array_dedup"](spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = {d[0]: (*p[:3], hashlib.sha256(p[3]).hexdigest()) for d, p in zip(docs, plain([d[1] for d in docs], 400))}
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_small_anchors_share_small_shards():
    rng = np.random.default_rng(3)
    runs = sorted((k // 2, rng.integers(0, 4, 1000, dtype=np.uint8).tobytes()) for k in range(200))
    columns = [[f"-:{a:03d}" for a, _ in runs], [r[:16] for _, r in runs], [r for _, r in runs], [1] * len(runs)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "id", "run", "copies"])
    found = list(_shards(iter([batch]), 400, 1 << 20))
    assert [i for _, ids, _, _ in found for i in ids] == columns[1]
    assert all(len(shard.data) < JOINED_BYTES + 4096 for *_, shard in found)
