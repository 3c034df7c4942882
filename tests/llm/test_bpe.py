import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from fleetlens.llm.bpe import Bpe, _Cache, _Table, bpe_decode, bpe_encode, encode_column, load
from fleetlens.llm.queries import QUERIES, TOKENIZER

from tests.llm.helpers import messy_documents

PATH = public_tokenizers.path(TOKENIZER)


def _odd_texts():
    rng = random.Random(3)
    fixed = [
        "", None, " ", "<|startoftext|>x<|endoftext|>", "don't I'LL we've 's's", "ΑΣ ΣΑΣ İstanbul ẞ", "É é ｆｕｌｌ", "x<|endoftext|",
        "日本語 テスト 👍🏽", "a" * 900, "1234 12a3", "\x00\x01\x85a b", "ab՘cd", "\r\n\t\x0b\x0c",
    ]
    ranges = [(32, 0x24F), (0x370, 0x5FF), (0x3040, 0x30FF), (0x1F300, 0x1F6FF), (0x301, 0x301), (0x200D, 0x200D)]
    mixed = ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    dense = ["".join(rng.choice("eint") for _ in range(rng.randint(1, 300))) for _ in range(100)]
    return [*fixed, *mixed, *dense]


def test_ids_and_texts_equal_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = _odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe_encode(docs, PATH)
    rows = bpe_decode(encoded, PATH).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_pairs_agree_with_merging_again():
    bpe = load(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(1)
    inner = [i for i in np.flatnonzero(bpe.length).tolist() if bpe.token_text[i].isascii() and bpe.token_text[i].isalpha()]
    ends = [
        i for i in np.flatnonzero(bpe.length).tolist()
        if bpe.token_text[i].endswith("</w>") and bpe.token_text[i][:-4].isascii() and bpe.token_text[i][:-4].isalpha()
    ]
    a, b = rng.choice(inner, 400), rng.choice(ends, 400)
    got = bpe.compatible(a, b)
    words = [bpe.token_text[x] + bpe.token_text[y][:-4] for x, y in zip(a, b)]
    want = [tokenizer.encode(w, add_special_tokens=False).ids == [x, y] for w, x, y in zip(words, a, b)]
    assert got.tolist() == want


def test_awkward_rows(spark):
    docs = messy_documents(spark)
    encoded = bpe_encode(docs, PATH)
    assert encoded.columns == [*[c for c in docs.columns if c != "ids"], "ids"]
    assert encoded.where("text is null").first()["ids"] == []
    assert encoded.count() == docs.count()
    nulls = bpe_decode(spark.createDataFrame([(1, None), (2, []), (3, [320])], "doc_id long, ids array<int>"), PATH)
    assert [r["decoded"] for r in nulls.orderBy("doc_id").collect()][:2] == [None, ""]
    assert bpe_encode(docs.limit(0), PATH).count() == 0


def test_query(spark, sf):
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_bpe"](spark, sf).collect():
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_pieces_and_pairs_are_encoded_once(monkeypatch):
    bpe = Bpe(PATH)
    met, pairs = [], []
    pieces_of, survive = bpe.encode_pieces, bpe._survive
    monkeypatch.setattr(bpe, "encode_pieces", lambda pieces: met.extend(pieces) or pieces_of(pieces))
    monkeypatch.setattr(bpe, "_survive", lambda a, b: pairs.extend(zip(a.tolist(), b.tolist())) or survive(a, b))
    tokenizer = Tokenizer.from_file(PATH)
    words = ["andonwhaned", "tionstanoueahe", "schbeschheit", "\u00f1asuemente", "andonwhanedtionstan"]
    for mark in ("", ",", ".", "(", "1"):  # other words each time, of the same pieces
        text = "\n".join(w + mark for w in words)
        ids, bounds = bpe.encode_words(text)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [
            tokenizer.encode(w, add_special_tokens=False).ids for w in text.split("\n")
        ]
    assert len(met) == len(set(met)) == len(words) + 4
    assert pairs and len(pairs) == len(set(pairs))


def test_caches_restart_when_they_are_full(monkeypatch):
    bpe = Bpe(PATH)
    monkeypatch.setattr("fleetlens.llm.bpe.MAX_CACHED", 40)
    monkeypatch.setattr("fleetlens.llm.bpe.load", lambda path: bpe)
    cache = _Cache(100)
    bpe.met = _Cache(70)
    monkeypatch.setattr("fleetlens.llm.bpe._words_met", lambda path: cache)
    tokenizer = Tokenizer.from_file(PATH)
    texts = _odd_texts()
    for i in range(0, len(texts), 20):
        for first, ids, bounds in encode_column(PATH, pa.array(texts[i : i + 20], pa.string())):
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                assert ids[a:b].tolist() == tokenizer.encode(texts[i + first + k] or "", add_special_tokens=False).ids


def test_table_grows():
    rng = np.random.default_rng(4)
    keys = np.unique(np.concatenate([rng.integers(0, 2**63, 5000, dtype=np.uint64), np.arange(3000, dtype=np.uint64) << np.uint64(40)]))
    rng.shuffle(keys)
    table = _Table(keys[:10], np.arange(10, dtype=np.int32))
    for at in range(10, len(keys), 700):
        assert (table.get(keys[at : at + 700]) < 0).all()
        table.add(keys[at : at + 700], np.arange(at, min(at + 700, len(keys)), dtype=np.int32))
    assert table.get(keys).tolist() == list(range(len(keys)))
