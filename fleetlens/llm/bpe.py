"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece there is exactly one token that ends its encoding.  A token that matches
the end of a prefix is that token if and only if it is compatible with the last token of the prefix
before it: the pair, spelled out and merged again, stays the same two tokens.  So one pass over the
prefixes, trying the vocabulary matches that end there, stores the last token of each, and
following the back-pointers from the end gives the exact ids.

The suffix matches come from a state per (piece, length) in one hash table over the vocabulary; all
distinct pieces of a batch advance together, as numpy arrays.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlens.llm.wordbatch import mix, ranges, slices, span_hashes

END = "</w>"
MAX_CACHED = 1 << 20  #: encoded words, encoded pieces and judged pairs that a Python worker keeps; each restarts beyond that
_SEED = np.uint64(0x2545F4914F6CDD1D)
_STEP = 0x9E3779B97F4A7C15
_ONE = np.uint64(int(_SEED) * _STEP & (2**64 - 1))
NEVER = np.iinfo(np.int64).max
SYMBOLS = 513  #: 1..256 a byte inside a piece, 257..512 the byte that ends it


class _Table:
    """Open-addressing map from 64-bit keys to 32-bit values, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.used = 0
        self._make(max(4, int(len(keys) * 3).bit_length()))
        self.add(keys, values)

    def _make(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the map yet."""
        self.used += len(keys)
        if self.used * 2 > len(self.keys):
            full = self.values >= 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            self._make(int(self.used * 3).bit_length())
        slot = keys & self.mask
        while len(keys):
            free = self.values[slot] < 0
            self.keys[slot[free]] = keys[free]
            # Of keys that meet in a free slot the one written last has it.
            put = free & (self.keys[slot] == keys)
            self.values[slot[put]] = values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self.mask
        value = self.values[slot]
        miss = self.keys[slot] != keys
        open_ = np.flatnonzero(miss & (value >= 0))
        value[miss] = -1
        slot = slot[open_]
        while len(open_):
            slot = (slot + np.uint64(1)) & self.mask
            found = self.values[slot]
            hit = self.keys[slot] == keys[open_]
            value[open_[hit]] = found[hit]
            go_on = ~hit & (found >= 0)
            open_, slot = open_[go_on], slot[go_on]
        return value


def _empty_table() -> _Table:
    return _Table(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))


class Bpe:
    """Vocabulary, merges and pre-splitting of a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["byte_fallback"]:
            raise ValueError("only BPE vocabularies with word ends are supported")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"] + "|\n")
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.token_text = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in [*vocab.items(), *self.special.items()]:
            self.token_text[number] = token
        self.met, self.verdicts = _Cache(MAX_CACHED), _empty_table()
        self._byte_symbols()
        size = len(self.token_text)
        spelled: dict[int, tuple[int, ...]] = {}
        for token, number in vocab.items():
            last = token.endswith(END) and token != END
            chars = token[: -len(END)] if last else token
            if all(c in self.byte_of for c in chars):
                code = [self.byte_of[c] + 1 for c in chars]
                code[-1] += 256 * last
                spelled[number] = tuple(code)
        self.rank = np.full(size, -1, dtype=np.int64)  # of the merge that makes a token; -1: a symbol
        self.left = np.full(size, -1, dtype=np.int32)
        self.right = np.full(size, -1, dtype=np.int32)
        pair_keys, pair_tokens = [], []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            whole = vocab[a + b]
            pair_keys.append(vocab[a] << 32 | vocab[b])
            pair_tokens.append(whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, vocab[a], vocab[b]
        # A missing merge, token -1, never comes: the last entry.
        self.rank_or_never = np.append(np.where(self.rank < 0, NEVER, self.rank), NEVER)
        self.merges = _Table(mix(np.array(pair_keys, dtype=np.uint64)), np.array(pair_tokens, dtype=np.int32))
        # Only tokens that merging can reach are candidates.
        reachable = [n for n, code in spelled.items() if len(code) == 1 or self.rank[n] >= 0]
        self.longest = max(len(spelled[n]) for n in reachable)
        self.length = np.zeros(size, dtype=np.int64)
        for n in reachable:
            self.length[n] = len(spelled[n])
        # The automaton reads symbols backwards: a state for every suffix of a token, with the token
        # plus one as its value, or 0 where only longer tokens end like that.
        states: dict[int, int] = {}
        for n in reachable:
            h = int(_SEED)
            for c in reversed(spelled[n]):
                h = (h * _STEP + c) & (2**64 - 1)
                states.setdefault(h, 0)
            states[h] = n + 1
        keys = mix(np.array(list(states), dtype=np.uint64))
        self.suffixes = _Table(keys, np.array(list(states.values()), dtype=np.int32))
        # The first two steps are looked up by symbol.
        symbol = np.arange(SYMBOLS, dtype=np.uint64)
        one = _ONE + symbol
        two = one[:, None] * np.uint64(_STEP) + symbol
        self.state_of_one = self.suffixes.get(mix(one))
        self.state_of_two = np.where(self.state_of_one[:, None] < 0, np.int32(-1), self.suffixes.get(mix(two.ravel())).reshape(two.shape)).ravel()
        # Characters that the splitting library counts as letters but the vocabulary's does not know yet.
        newer = [c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Cn"]
        counted = regex.compile(r"[\p{L}\p{N}]")
        self.newer = {c for c in newer if counted.match(c)}

    def _byte_symbols(self) -> None:
        """The printable character that stands for each byte in the vocabulary."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens stays; the verdicts met before are looked up."""
        keys = mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
        found = self.verdicts.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            once, first, again = np.unique(keys[new], return_index=True, return_inverse=True)
            verdict = self._survive(a[new[first]], b[new[first]]).astype(np.int32)
            found[new] = verdict[again]
            if self.verdicts.used + len(once) > MAX_CACHED:
                self.verdicts = _empty_table()
            self.verdicts.add(once, verdict)
        return found > 0

    def _survive(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens survives being spelled out and merged again.

        Undoes the later of the two last merges step by step; a merge across the seam that would
        have come before the undone one breaks the pair.
        """
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y, limit = a, b, np.full(len(a), NEVER)
        while len(live):
            merged = self.merges.get(mix((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64)))
            across = self.rank_or_never[merged]
            broken = across < limit
            ok[live[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = np.flatnonzero(~broken & ((rx >= 0) | (ry >= 0)))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            # Undo the merge that came last: of equal ranks the right one, as merging goes from the left.
            left_side = rx > ry
            limit = np.where(left_side, rx, ry + 1)
            x, y = np.where(left_side, self.right[x], x), np.where(left_side, y, self.left[y])
        return ok

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces: all ids, and the bounds of each piece."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")  # longest first: the pieces still going are a prefix
        start = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64) + 1
        data[start[1:][lengths > 0] - 1] += 256
        symbols = data.astype(np.uint64)
        last = np.full(len(data), -1, dtype=np.int32)  # the last token of the prefix that ends here
        at_start = start[:-1][order]
        sorted_lengths = lengths[order]
        for i in range(int(sorted_lengths[0]) if len(order) else 0):
            going = at_start[: int(np.searchsorted(-sorted_lengths, -i, side="left"))]
            here = going + i
            alive = np.arange(len(here))
            first = data[here]
            candidates = []
            for size in range(1, min(i + 1, self.longest) + 1):
                if size == 1:
                    state = self.state_of_one[first]
                elif size == 2:
                    second = data[here[alive] - 1]
                    state = self.state_of_two[first[alive] * SYMBOLS + second]
                    h = (_ONE + symbols[here[alive]]) * np.uint64(_STEP) + symbols[here[alive] - 1]
                else:
                    h = h * np.uint64(_STEP) + symbols[here[alive] - size + 1]
                    state = self.suffixes.get(mix(h))
                on = state >= 0
                alive, state = alive[on], state[on]
                if size > 1:
                    h = h[on]
                if not len(alive):
                    break
                hit = state > 0
                if hit.any():
                    candidates.append((size, alive[hit], state[hit] - 1))
            found = np.full(len(here), -1, dtype=np.int32)
            for size, at, token in reversed(candidates):
                still = found[at] < 0
                at, token = at[still], token[still]
                if size == i + 1:
                    fits = np.ones(len(at), dtype=bool)
                else:
                    fits = self.compatible(last[here[at] - size], token)
                found[at[fits]] = token[fits]
            last[here] = found
        # Back-pointers, for all pieces at once.
        owner, ids, place = [], [], []
        live = np.flatnonzero(lengths > 0)
        at = start[live + 1] - 1
        step = 0
        while len(live):
            token = last[at]
            owner.append(live)
            ids.append(token)
            place.append(np.full(len(live), step))
            at = at - self.length[token]
            keep = at >= start[live]
            live, at = live[keep], at[keep]
            step += 1
        if not owner:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(pieces) + 1, dtype=np.int64)
        owner, ids, place = np.concatenate(owner), np.concatenate(ids), np.concatenate(place)
        sort = np.lexsort((-place, owner))
        counts = np.bincount(owner, minlength=len(pieces))
        return ids[sort].astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def encode_met(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_pieces``, of distinct pieces; those met before are looked up."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(sizes)
        filled = np.flatnonzero(sizes)
        hashes = span_hashes(np.frombuffer(b"".join(pieces), dtype=np.uint8), (ends - sizes)[filled], ends[filled])
        rows = self.met.rows(hashes, lambda new: self.encode_pieces([pieces[i] for i in filled[new].tolist()]))
        ids, counts = self.met.of(rows)
        total = np.zeros(len(pieces) + 1, dtype=np.int64)
        total[filled + 1] = counts
        return ids, np.cumsum(total)

    def _lower(self, text: str) -> str:
        """Composed and lower-cased, character by character: no context decides a letter's case."""
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def _split(self, text: str) -> list[str]:
        """Pieces of a lower-cased text; a line feed stays as a piece of its own."""
        if text.isascii() or self.newer.isdisjoint(text):
            return self.pieces.findall(text)
        masked = text.translate(dict.fromkeys(map(ord, self.newer), "\u2e3a"))  # neither letter nor number
        return [text[m.start() : m.end()] for m in self.pieces.finditer(masked)]

    def _with_special(self, word: str) -> list[str | int]:
        out, at = [], 0
        for m in self.special_pattern.finditer(word):
            out += [*self._split(self._lower(word[at : m.start()])), self.special[m.group()]]
            at = m.end()
        return out + self._split(self._lower(word[at:]))

    def encode_words(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of white-space-free words, one per line: all ids, and the bounds of each word."""
        n = words.count("\n") + 1
        if "<|" in words and self.special_pattern.search(words):
            found: list[str | int] = []
            for i, word in enumerate(words.split("\n")):
                found += ["\n"] * bool(i) + self._with_special(word)
        else:
            found = self._split(self._lower(words))
        codes, unique = pd.factorize(np.array(found, dtype=object))
        is_special = np.array([isinstance(u, int) for u in unique], dtype=bool)
        texts = [b"" if special or u == "\n" else u.encode() for u, special in zip(unique, is_special)]
        ids, bounds = self.encode_met(texts)
        if is_special.any():
            extra = np.flatnonzero(is_special)
            ids = np.insert(ids, bounds[extra], [unique[i] for i in extra]).astype(np.uint32)
            bounds = bounds + np.concatenate([[0], np.cumsum(is_special)])
        sizes = np.diff(bounds)[codes]
        line_end = np.array([u == "\n" for u in unique], dtype=bool)[codes]
        flat = ids[ranges(bounds[:-1][codes], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], total[:-1][line_end], [total[-1]]])
        assert len(ends) == n + 1
        return flat, ends


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


class _Cache:
    """Ids of what this worker has met, by hash."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index = _empty_table()
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.bounds = np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def rows(self, hashes: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Row of every one of some distinct hashes; ``encode`` gives the ids and bounds of those that are new."""
        rows = self.index.get(hashes)
        new = np.flatnonzero(rows < 0)
        if len(new) and self.index.used + len(new) > self.most and self.index.used:
            self.clear()
            new = np.arange(len(hashes))
        if len(new):
            ids, bounds = encode(new)
            first = self.index.used
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while first + len(new) + 1 > len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.bounds[first : first + len(new) + 1] = bounds + self.used
            self.used += len(ids)
            rows[new] = np.arange(first, first + len(new), dtype=np.int32)
            self.index.add(hashes[new], rows[new])
        return rows

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows, and how many each has."""
        starts = self.bounds[rows]
        sizes = self.bounds[rows + 1] - starts
        return self.flat[ranges(starts, sizes)], sizes


@lru_cache(maxsize=2)
def _words_met(path: str) -> _Cache:
    return _Cache(MAX_CACHED)


def encode_column(path: str, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column: first text, the ids of its texts, and the bounds of each text."""
    cache, bpe = _words_met(path), load(path)
    for part in slices(column):
        codes, unique = pd.factorize(part.hashes())
        if len(unique):
            where = np.zeros(len(unique), dtype=np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]  # first word with each code
            rows = cache.rows(unique, lambda new: bpe.encode_words(part.lines(where[new]).decode("utf-8", "replace")))
            ids, sizes = cache.of(rows[codes])
        else:
            sizes, ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        yield part.first, ids, ends[part.bounds]


def decode(bpe: Bpe, ids: np.ndarray) -> str:
    """Tokens joined by single spaces: a vocabulary without a decoder decodes like that."""
    text = bpe.token_text
    return " ".join([text[i] for i in ids.tolist()])


def bpe_encode(documents: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the exact token ids of every whole text.

    Equal to the tokenizers library on the file at ``path`` without added special tokens; special
    tokens that stand in a text are matched.  Null counts as empty and gives no ids.  A column named
    ``ids`` is replaced; all others pass through.  Only the words of a batch are held in memory, and a worker keeps at
    most ``MAX_CACHED`` encoded words between batches.
    """
    kept = [c for c in documents.columns if c != ids]
    if text not in kept:
        raise ValueError("the ids cannot replace the text they are made of")
    frame = documents.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([*frame.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, bounds in encode_column(path, batch.column(at)):
                part = batch.slice(first, len(bounds) - 1)
                values = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, ids])

    return frame.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the ids decoded with special tokens kept.  Null ids give a null text."""
    kept = [c for c in encoded.columns if c != text]
    frame = encoded.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([*frame.schema.fields, T.StructField(text, T.StringType())])
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(path).token_text
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                column = part.column(at)
                size = np.nan_to_num(np.array(column.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(int)
                words = [tokens[t] for t in column.flatten().to_numpy().tolist()]
                ends = np.cumsum(size)
                texts = [
                    " ".join(words[e - n : e]) if ok else None
                    for e, n, ok in zip(ends.tolist(), size.tolist(), column.is_valid().to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text])

    return frame.mapInArrow(run, schema)


def bpe_round_trip(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns but the text, with ``n_tokens`` and SHA-256 digests of the ids and of their decoding.

    The ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8.  Encodes
    and decodes as ``bpe_encode`` and ``bpe_decode`` do, but keeps neither ids nor texts.
    """
    own = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in documents.columns if c not in own and c != text]
    frame = documents.select(*[f"`{c}`" for c in kept], f"`{text}`")
    schema = frame.drop(text).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            for _, flat, bounds in encode_column(path, batch.column(len(kept))):
                raw = flat.astype("<u4")
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    counts.append(b - a)
                    of_ids.append(hashlib.sha256(raw[a:b]).hexdigest())
                    of_texts.append(hashlib.sha256(decode(bpe, flat[a:b]).encode()).hexdigest())
            values = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *values], names=[*kept, *own])

    return frame.mapInArrow(run, schema)
