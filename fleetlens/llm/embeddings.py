"""Near-duplicate vectors: spherical k-means cells, blocked cosines within cells, one kept per group.

A vector belongs to the cell of its nearest centroid.  Of two unit vectors in different cells whose
chord is ``c``, at least one lies within ``c / 2`` of the plane that separates the two centroids;
each vector within that margin is also copied into the other cell.  So every pair above the
threshold meets in a cell, whatever the centroids, and recall does not depend on the fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.components import connected_components
from fleetlens.llm.storage import stored

THRESHOLD = 0.95
SAMPLE = 16384  #: vectors, chosen by hash, that the centroids are fitted on
MAX_CELLS = 1024  #: bounds the broadcast centroids
HOSTS = 1024  #: vectors at home in a cell that one task compares
MEMBERS = 4096  #: with so many members of the cell
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(vectors, width: int) -> np.ndarray:
    vectors = list(vectors)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, dtype=np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids; starts from evenly spaced rows of ``x``, which come in hash order."""
    x = _unit(x)
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = np.concatenate([np.argmax(x[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, cell, x)
        norm = np.linalg.norm(total, axis=1)
        centroids[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centroids


def cells_of(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest cell of each unit vector, and a mask of the cells that get a copy (its own included)."""
    near = x @ centroids.T
    own = np.argmax(near, axis=1)
    gap = near[np.arange(len(x)), own][:, None] - near
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centroids @ centroids.T))[own]
    margin = np.sqrt(2 - 2 * threshold) / 2 + SLACK
    copy = gap <= margin * apart + SLACK
    copy[np.arange(len(x)), own] = True
    return own, copy


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable from each row and each column of a mask over two sides with ids."""
    left, right = left.copy(), right.copy()
    none = np.iinfo(np.int64).max
    while True:
        to_right = np.minimum(right, np.where(linked, left[:, None], none).min(axis=0, initial=none))
        to_left = np.minimum(left, np.where(linked, to_right[None, :], none).min(axis=1, initial=none))
        if (to_left == left).all() and (to_right == right).all():
            return left, right
        left, right = to_left, to_right


def _compare(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between a block of the vectors at home in a cell and a block of all its members."""
    cell = int(group["cell"].iloc[0])
    host, other = group[group["host"]], group[~group["host"]]
    if not len(host) or not len(other):
        return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
    size, other_size = host["vector"].str.len().to_numpy(), other["vector"].str.len().to_numpy()
    width = int(max(size.max(), other_size.max()))
    x, y = _matrix(host["vector"], width), _matrix(other["vector"], width)
    linked = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) >= threshold
    rep, other_rep = host["rep"].to_numpy(), other["rep"].to_numpy()
    keep = linked.any(axis=1)
    also = linked.any(axis=0)
    linked = linked[np.ix_(keep, also)]
    host, other, rep, other_rep = host[keep], other[also], rep[keep], other_rep[also]
    linked &= size[keep][:, None] == other_size[also][None, :]
    linked &= rep[:, None] != other_rep[None, :]
    home = other["home"].to_numpy()
    # A pair of two cells that meets in both counts in the smaller one only.
    for b in np.unique(home[home < cell]):
        both = np.array([b in c for c in host["cells"]])
        linked[np.ix_(both, home == b)] = False
    if not linked.any():
        return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
    weight, other_weight = host["weight"].to_numpy(), other["weight"].to_numpy()
    root, other_root = _roots(linked, rep, other_rep)
    links = (linked @ other_weight).astype("int64")
    # Of two vectors at home here each is a host in its turn; a guest gets its count from its host.
    other_links = np.where(home == cell, 0, weight @ linked).astype("int64")
    out = pd.DataFrame(
        {
            "rep": np.concatenate([rep, other_rep]),
            "links": np.concatenate([links, other_links]),
            "root": np.concatenate([root, other_root]),
        }
    )
    return out[(out["links"] > 0) | (out["root"] != out["rep"])]


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
    max_cells: int = MAX_CELLS,
    hosts: int = HOSTS,
    members: int = MEMBERS,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """One row per input row: ``<key>, n_links, component_id, kept``.

    Two vectors link if their cosine in double precision is ``threshold`` or more.  Vectors that are
    null, empty, zero, or hold null or non-finite components, and rows with a null key, link with
    nothing (a null key is never kept).  Vectors of different lengths do not link.  Rows that repeat
    a key count as one vector, the smallest of their vectors.  Equal vectors are compared once and
    weighted.  An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    element = vectors.schema[vector].dataType.elementType
    floats = isinstance(element, (T.FloatType, T.DoubleType))
    finite = (lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) if floats else (lambda e: e.isNotNull())
    usable = (
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.coalesce(F.forall("v", finite), F.lit(False)) & F.coalesce(F.exists("v", lambda e: e != 0), F.lit(False))
    )
    by_id = rows.where(usable).groupBy("id").agg(F.min("v").alias("v"))
    by_id = stored(by_id, "vectors")
    classes = stored(by_id.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "vector-classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = facts["n"], facts["width"] or 1
    drawn = [
        r["v"] for r in classes.select("v", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(sample).collect()
    ]
    k = int(max(1, min(max_cells, np.sqrt(n) / 4, len(drawn) // 8)))
    centroids = spherical_kmeans(_matrix(drawn, width), k) if drawn else np.ones((1, width))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                own, copy = cells_of(_unit(_matrix(part["v"], width)), shared.value, threshold)
                yield pd.DataFrame(
                    {
                        "rep": part["rep"].to_numpy(), "weight": part["weight"].to_numpy(), "home": own.astype("int32"),
                        "cells": [np.flatnonzero(c).astype("int32") for c in copy], "vector": list(part["v"]),
                    }
                )

    kind = element.simpleString() if floats else "double"
    assigned = stored(
        classes.mapInPandas(assign, f"rep long, weight long, home int, cells array<int>, vector array<{kind}>"),
        "vector-cells",
    )
    copies = assigned.withColumn("cell", F.explode("cells"))
    # One row per cell, at most max_cells of them: how many blocks its hosts and members fill.
    blocks = F.broadcast(
        copies.groupBy("cell").agg(
            F.ceil(F.count(F.when(F.col("home") == F.col("cell"), 1)) / hosts).cast("int").alias("host_blocks"),
            F.ceil(F.count("*") / members).cast("int").alias("member_blocks"),
        )
    )
    sized = copies.join(blocks, "cell")
    part = F.xxhash64("rep")
    columns = ["cell", "i", "j", "host", "rep", "weight", "home", "cells", "vector"]
    as_host = (
        sized.where("home = cell")
        .withColumn("i", F.pmod(part, F.col("host_blocks")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)))
        .withColumn("host", F.lit(True))
        .select(*columns)
    )
    as_member = (
        sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("host_blocks") - 1)))
        .withColumn("j", F.pmod(part, F.col("member_blocks")).cast("int"))
        .withColumn("host", F.lit(False))
        .where("host_blocks > 0")
        .select(*columns)
    )
    found = stored(
        as_host.unionByName(as_member)
        .groupBy("cell", "i", "j")
        .applyInPandas(lambda g: _compare(g, threshold), "rep long, links long, root long"),
        "vector-links",
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classified = (
        by_id.join(classes, "v").select("id", "rep", "weight")
        .join(links, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "id",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return (
        rows.select("id")
        .join(classified, "id", "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
        )
    )
