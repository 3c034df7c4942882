"""Small tables with every awkward case, and plain versions of the measures."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns that operators use themselves clash with these on purpose.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, row string, kept string, "
    "score string, n_words string, ids string, packed string, spans string"
)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def messy_texts(seed: int = 1) -> list[str | None]:
    """Nulls, empty and blank texts, one very long word run, ties, copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "straße", "日本", "a.", "it's"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    base = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 3, 5, 20, 40, 90, 200, 200)]
    texts: list[str | None] = [None, "", " \n\t ", *base, base[6], base[6], base[3]]
    for _ in range(4):
        near = base[7].split()
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    for _ in range(3):
        texts.append(f"{rng.choice(vocabulary)} {passage}\n{base[rng.randrange(8)]}")
    texts.append("same " * 120)
    texts.append("\n".join(["line one two"] * 30))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(9000)))
    return texts


def messy_documents(spark, seed: int = 1):
    """The texts as documents with null keys, languages and sources, a repeated row and other columns."""
    rows = [
        (i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"src{i % 2}", len(t or ""), "k", None, "x", "s", "n", "i", "p", None)
        for i, t in enumerate(messy_texts(seed))
    ]
    rows += [(None, "a row without a key " * 3, "en", "src0", 60, *[None] * 8), rows[8], rows[8]]
    return spark.createDataFrame(rows, SCHEMA)


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, str]]:
    """(words, removed words, kept text) by counting every window."""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in all_words for i in range(len(w) - length + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingle_set(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_links(texts: list[str | None], threshold: float = 0.8) -> dict[int, set[int]]:
    sets = [shingle_set(t) for t in texts]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both / (len(a) + len(sets[j]) - both) >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def smallest_reachable(n: int, links: dict[int, set[int]]) -> list[int]:
    out = list(range(n))
    for i in range(n):
        if out[i] != i:
            continue
        todo = [i]
        while todo:
            for j in links[todo.pop()]:
                if out[j] > i:
                    out[j] = i
                    todo.append(j)
    return out
