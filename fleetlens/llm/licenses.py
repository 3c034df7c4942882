"""License scans: a trained paragraph classifier, confirmed against templates.

Paragraphs (lines with a word) are scored by multinomial logistic regression over hashed word
1- to 3-grams.  It learns from perturbed template sentences of each family and from ordinary
paragraphs of the corpus as the unknown class; its scale is calibrated on held-back examples so that
probabilities mean what they say.  A family prediction holds only if the paragraph also contains
enough of one template's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.wordbatch import PUNCTUATION, Words, gram_hashes, mix, slices, string_buffers, words_of

#: Sentences by which each family is usually declared.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is released under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License",
        "Distributed under the GNU General Public License version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "proprietary": (
        "All rights reserved. No part of this work may be reproduced without prior written permission.",
        "Copyright. All rights reserved.",
    ),
}
UNKNOWN = "unknown"
CLASSES = (UNKNOWN, *TEMPLATES)

BITS = 16  #: hashed feature space
#: Adjacent words that are scored together, and the step between such spans.  A longer paragraph is
#: scored by its best span: short ones find a sentence among other words, long ones a long template.
SPANS = ((8, 2), (12, 4), (24, 8))
SAMPLE = 4000  #: ordinary paragraphs, chosen by hash, that the unknown class learns from
PER_TEMPLATE = 60  #: perturbed copies of each template sentence
MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.6  #: of a template's word pairs that the paragraph must contain


@dataclass
class LicenseModel:
    weights: np.ndarray  #: (features, classes)
    bias: np.ndarray
    scale: float  #: calibrated: probabilities are softmax(scale * logits)
    threshold: float


def _line_words(text: pa.Array) -> Words:
    at, data = string_buffers(pc.utf8_lower(text))
    return words_of(data[at[0] : at[-1]], at, 0, PUNCTUATION)


def _features(h: np.ndarray) -> list[np.ndarray]:
    """Feature of the 1-, 2- and 3-gram that starts at every word (shorter at the end)."""
    out = []
    for n in (1, 2, 3):
        grams = h if n == 1 else gram_hashes(h, n)
        out.append((mix(grams ^ np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def _rows(texts: list[str]) -> list[np.ndarray]:
    """Distinct features of each text."""
    part = _line_words(pa.array(texts, pa.string()))
    h = part.hashes()
    return [np.unique(np.concatenate(_features(h[a:b]))) if b > a else np.zeros(0, np.int64) for a, b in zip(part.bounds[:-1], part.bounds[1:])]


def _examples(ordinary: list[str], seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Perturbed templates, some inside ordinary words, and ordinary paragraphs."""
    rng = np.random.default_rng(seed)
    filler = [w for t in ordinary[:400] for w in t.split()[:30]] or ["text"]
    texts, labels = [], []
    for number, family in enumerate(TEMPLATES, start=1):
        for sentence in TEMPLATES[family]:
            words = sentence.split()
            for _ in range(PER_TEMPLATE):
                keep = [w for w in words if rng.random() > 0.05] or words
                if rng.random() < 0.5:
                    extra = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(1, 12)))]
                    keep = extra[: len(extra) // 2] + keep + extra[len(extra) // 2 :] if rng.random() < 0.5 else keep + extra
                texts.append(" ".join(keep))
                labels.append(number)
    for t in ordinary:
        words = t.split()
        for span, _ in SPANS:
            at = int(rng.integers(0, max(1, len(words) - span + 1)))
            texts.append(" ".join(words[at : at + span]))
            labels.append(0)
    # Words of declarations out of order say nothing.
    every = [w for f in TEMPLATES.values() for s in f for w in s.split()]
    for _ in range(400):
        texts.append(" ".join(every[i] for i in rng.integers(0, len(every), int(rng.integers(1, 5)))))
        labels.append(0)
    return texts, np.array(labels)


def train(ordinary: list[str], epochs: int = 40, rate: float = 0.5, penalty: float = 1e-5) -> LicenseModel:
    """Sparse logistic regression by adaptive gradient steps; a fifth of the examples calibrates."""
    texts, labels = _examples(_without_templates(ordinary))
    rows = _rows(texts)
    order = np.random.default_rng(5).permutation(len(rows))
    split = len(order) // 5
    held, taught = order[:split], order[split:]
    k = len(CLASSES)
    weights, bias = np.zeros((1 << BITS, k)), np.zeros(k)
    grown = np.full((1 << BITS, k), 1e-8)

    def stacked(which):
        size = np.array([len(rows[i]) for i in which])
        return np.concatenate([rows[i] for i in which]), np.repeat(np.arange(len(which)), size), 1 / np.sqrt(np.maximum(size, 1))

    def logits(flat, owner, norm, n):
        out = np.zeros((n, k))
        np.add.at(out, owner, weights[flat])
        return out * norm[:, None] + bias

    flat, owner, norm = stacked(taught)
    y = np.eye(k)[labels[taught]]
    for _ in range(epochs):
        z = logits(flat, owner, norm, len(taught))
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - y) / len(taught)
        step = np.zeros_like(weights)
        np.add.at(step, flat, error[owner] * norm[owner, None])
        step += penalty * weights
        grown += step**2
        weights -= rate * step / np.sqrt(grown)
        bias -= rate * error.sum(axis=0)
    z = logits(*stacked(held), len(held))

    def loss(scale):
        q = scale * z - (scale * z).max(axis=1, keepdims=True)
        return -(q[np.arange(len(held)), labels[held]] - np.log(np.exp(q).sum(axis=1))).mean()

    scale = min(np.geomspace(0.25, 8, 25), key=loss)
    return LicenseModel(weights, bias, float(scale), MIN_PROBABILITY)


def _template_pairs() -> list[tuple[int, str, np.ndarray]]:
    out = []
    for number, family in enumerate(TEMPLATES, start=1):
        for sentence in TEMPLATES[family]:
            h = _line_words(pa.array([sentence])).hashes()
            out.append((number, sentence, np.unique(gram_hashes(h, 2))))
    return out


def _without_templates(texts: list[str]) -> list[str]:
    """Texts that hold under a third of every template's word pairs."""
    templates = _template_pairs()
    part = _line_words(pa.array(texts, pa.string()))
    h = part.hashes()
    out = []
    for text, a, b in zip(texts, part.bounds[:-1], part.bounds[1:]):
        have = np.unique(gram_hashes(h[a:b], 2))
        if all(np.isin(pairs, have).mean() < 1 / 3 for _, _, pairs in templates if len(pairs)):
            out.append(text)
    return out


def _template_overlap(h: np.ndarray, family: int, templates) -> tuple[float, str]:
    """Largest share of a template's word pairs among those of some words, and the template."""
    have = np.unique(gram_hashes(h, 2))
    best = max(((np.isin(pairs, have).mean() if len(pairs) else 0.0, text) for number, text, pairs in templates if number == family))
    return float(best[0]), best[1]


OUTPUT = (
    "paragraph int, family string, probability double, template string, overlap double, confirmed boolean, "
    "first_word int, n_words int"
)


def scan_paragraphs(part: Words, model: LicenseModel, templates) -> list[tuple]:
    """(text, family, probability, template, overlap, confirmed, first word, words) of each text with a family."""
    h = part.hashes()
    count = np.diff(part.bounds)
    if not len(h):
        return []
    # Weight of the grams that start at each word and end in the same text.
    left = np.repeat(part.bounds[1:], count) - np.arange(len(h))
    value = np.zeros((len(h), len(CLASSES)), dtype=np.float32)
    weights = model.weights.astype(np.float32)
    number = np.zeros(len(h))
    for n, feature in zip((1, 2, 3), _features(h)):
        whole = np.flatnonzero(left >= n)
        value[whole] += weights[feature[whole]]
        number[whole] += 1
    total = np.concatenate([np.zeros((1, len(CLASSES))), np.cumsum(value, axis=0, dtype=np.float64)])
    grams = np.concatenate([[0.0], np.cumsum(number)])
    best: dict[int, tuple] = {}
    for span, step in SPANS:
        # Each text in steps, the last span at its end.
        steps = np.where(count > 0, np.maximum(1, -(-(count - span) // step) + 1), 0)
        owner = np.repeat(np.arange(part.n), steps)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps)) * step
        first = part.bounds[owner] + np.minimum(place, np.maximum(count[owner] - span, 0))
        last = np.minimum(first + span, part.bounds[owner + 1])
        z = (total[last] - total[first]) / np.sqrt(np.maximum(grams[last] - grams[first], 1))[:, None] + model.bias
        family = z[:, 1:].argmax(axis=1) + 1
        likely = np.flatnonzero(z[np.arange(len(z)), family] > z[:, 0])
        q = model.scale * (z[likely] - z[likely].max(axis=1, keepdims=True))
        chance = np.exp(q[np.arange(len(q)), family[likely]]) / np.exp(q).sum(axis=1)
        for i, probability in zip(likely.tolist(), chance.tolist()):
            if probability < model.threshold:
                continue
            t, name = int(owner[i]), int(family[i])
            overlap, template = _template_overlap(h[first[i] : last[i]], name, templates)
            rank = (overlap >= MIN_OVERLAP, probability)
            if t not in best or rank > best[t][0]:
                best[t] = rank, (
                    t, CLASSES[name], probability, template, overlap, overlap >= MIN_OVERLAP,
                    int(first[i] - part.bounds[t]), int(last[i] - first[i]),
                )
    return [best[t][1] for t in sorted(best)]


def scan_licenses(
    documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, confirmed_only: bool = True
) -> DataFrame:
    """One row per paragraph that declares a licence: ``<key>, paragraph, family, probability, template, overlap, confirmed, first_word, n_words``.

    ``paragraph`` is the number of the line in the text, from 0.  ``first_word`` and ``n_words`` are
    the span that was scored highest.  The unknown class learns from at most ``sample`` paragraphs,
    chosen by hash, that contain none of the words licen*, copyright, rights or permission; all
    paragraphs of all texts are scored.  Null and empty texts have no paragraphs.  Repeated rows give
    repeated results; null keys stay null; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    drawn = (
        docs.select(F.xxhash64("_text").alias("h"), "_text")
        .orderBy("h")
        .limit(max(1, sample // 8))
        .select(F.explode(F.slice(F.split("_text", "\n"), 1, 8)).alias("line"))
        .where(~F.lower("line").rlike("licen|copyright|rights|permission|spdx") & (F.length("line") > 0))
        .select(F.substring("line", 1, 2000).alias("line"))
        .limit(sample)
    )
    model = train(sorted(r["line"] for r in drawn.collect()))
    shared = spark.sparkContext.broadcast((model, _template_pairs()))
    schema = docs.select(key).schema
    for field in spark.createDataFrame([], OUTPUT).schema:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, templates = shared.value
        kinds = [pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.int32()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, texts = batch.column(0).slice(at, 500), batch.column(1).slice(at, 500)
                lines = pc.split_pattern(pc.utf8_lower(texts), "\n")
                owner = pc.list_parent_indices(lines).to_numpy()
                starts = np.searchsorted(owner, np.arange(len(texts)))
                found = []
                for part in slices(pc.list_flatten(lines), size=1 << 20, gaps=PUNCTUATION):
                    for one in scan_paragraphs(part, model, templates):
                        if one[5] or not confirmed_only:
                            found.append((one[0] + part.first, *one[1:]))
                if not found:
                    continue
                which = np.array([f[0] for f in found])
                columns = [keys.take(pa.array(owner[which])), pa.array((which - starts[owner[which]]).astype(np.int32))]
                columns += [pa.array([f[i] for f in found], kinds[i]) for i in range(1, 8)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
