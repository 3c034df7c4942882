"""Merkle manifest: a content-addressed tree over the rows of a table, proofs and their verification.

Every group (source) has a tree over its leaves, and the roots of the groups have a tree of their own.
A node is the digest of up to ``ARITY`` adjacent nodes below it.  Trees are built in *blocks* of
``DIGITS`` levels: a block gathers at most ``ARITY ** DIGITS`` adjacent nodes, and stores the records
digest -> children of all nodes inside it, so a table of a billion rows takes four rounds of one shuffle
each, and a group of any size is spread over its blocks.

Proofs come from descending the stored records: from the root down, the digits of a rank (base
``ARITY``) select a child, and the children not selected are collected.  The path down to the top of a
block is shared by everything below it: a block takes its path from the block above, appends a segment
per member, and hands it on.  Read backwards, a leaf's segments are its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.ranking import ranked
from fleetlens.llm.storage import stored

ARITY = 3
DIGITS = 5
SPAN = ARITY**DIGITS

_RECORDS = T.ArrayType(T.StructType([T.StructField("digest", T.StringType()), T.StructField("children", T.ArrayType(T.StringType()))]))
_PATH = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("siblings", T.ArrayType(T.StringType()))]))


def row_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as ``-`` if null, else byte count, colon, value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def levels_of(n: int) -> int:
    """Levels between ``n`` adjacent nodes and the top of their block."""
    height = 0
    while n > 1 and height < DIGITS:
        n, height = -(-n // ARITY), height + 1
    return height


def _height(n: int) -> int:
    """Levels of a block in a layer of ``n`` nodes: all of them, unless the layer fits into one block."""
    return DIGITS if n > SPAN else levels_of(n)


def build_block(nodes: list[str], height: int) -> tuple[str, dict[str, list[str]]]:
    """Top digest and records of a block."""
    records = {}
    for _ in range(height):
        above = []
        for i in range(0, len(nodes), ARITY):
            children = nodes[i : i + ARITY]
            digest = hashlib.sha256("".join(children).encode()).hexdigest()
            records[digest] = children
            above.append(digest)
        nodes = above
    return nodes[0], records


def descend(top: str, records: dict[str, list[str]], place: int, height: int) -> tuple[str, list[tuple[int, list[str]]]]:
    """The node at ``place`` under ``top``, and per level (downwards) the digit and the children not selected."""
    node, path = top, []
    for level in reversed(range(height)):
        digit = place // ARITY**level % ARITY
        children = records[node]
        path.append((digit, children[:digit] + children[digit + 1 :]))
        node = children[digit]
    return node, path


def _blocks(nodes: DataFrame) -> DataFrame:
    """``tree, block, n, members, top, records`` from ``tree, n, rank, digest, load`` (``n`` nodes in the layer)."""
    gathered = nodes.groupBy("tree", "n", (F.col("rank") / SPAN).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "digest", "load"))).alias("members")
    )
    schema = T.StructType([*gathered.schema.fields, T.StructField("top", T.StringType()), T.StructField("records", _RECORDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))
        for batch in batches:
            members = batch.column(3)
            sizes, tops, all_records = batch.column(1).to_pylist(), [], []
            for n, inside in zip(sizes, members):
                top, records = build_block(inside.values.field("digest").to_pylist(), _height(n))
                tops.append(top)
                all_records.append([{"digest": d, "children": c} for d, c in records.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string()), pa.array(all_records, kind)], names=schema.names)

    return gathered.mapInArrow(run, schema)


def _build(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Stored blocks of all layers, lowest first; ``largest`` is the number of nodes of the largest tree."""
    layers = [stored(_blocks(nodes), "merkle-blocks")]
    while largest > SPAN:
        largest = -(-largest // SPAN)
        above = layers[-1].where(F.col("n") > SPAN).select(
            "tree", F.ceil(F.col("n") / SPAN).alias("n"), F.col("block").alias("rank"), F.col("top").alias("digest"),
            F.lit(None).cast(nodes.schema["load"].dataType).alias("load"),
        )
        layers.append(stored(_blocks(above), "merkle-blocks"))
    return layers


def _tops(layers: list[DataFrame]) -> DataFrame:
    """``tree, top`` of every finished tree."""
    done = [b.where(F.col("n") <= SPAN).select("tree", "top") for b in layers]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _segments(blocks: DataFrame) -> DataFrame:
    """A row per member of a block with its path: ``tree, rank, digest, load, base, path``."""
    member = blocks.schema["members"].dataType.elementType
    schema = T.StructType(
        [blocks.schema["tree"], member["rank"], member["digest"], member["load"], blocks.schema["base"], T.StructField("path", _PATH)]
    )
    step = pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in ("n", "block", "members", "top", "records", "path")}
            for i in range(batch.num_rows):
                members = columns["members"][i].values
                records = {r["digest"]: r["children"] for r in columns["records"][i].as_py()}
                top, height = columns["top"][i].as_py(), _height(columns["n"][i].as_py())
                first = columns["block"][i].as_py() * SPAN
                above = [(s["place"], s["siblings"]) for s in columns["path"][i].as_py()]
                places, siblings, ends, sizes = [], [], [0], [0]
                for rank, digest in zip(members.field("rank").to_pylist(), members.field("digest").to_pylist()):
                    node, path = descend(top, records, rank - first, height)
                    if node != digest:
                        raise ValueError(f"the records of {top} do not lead to {digest}")
                    for place, others in [*above, *path]:
                        places.append(place)
                        siblings += others
                        sizes.append(len(siblings))
                    ends.append(len(places))
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(siblings, pa.string()))
                steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), lists], fields=list(step))
                n = len(members)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("tree")[i].as_py()] * n, pa.string()), members.field("rank"), members.field("digest"),
                        members.field("load"), batch.column("base").take(pa.array([i] * n)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps),
                    ],
                    names=schema.names,
                )

    return blocks.mapInArrow(run, schema)


def _descend(layers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of all leaves; ``paths (tree, base, path)`` lead from the root to the tops of the trees."""
    start = paths.withColumn("block", F.lit(0).cast("long"))
    found = None
    for blocks in reversed(layers):
        into = blocks.where(F.col("n") <= SPAN).join(start, ["tree", "block"])
        if found is not None:
            lower = found.select("tree", F.col("rank").alias("block"), "base", "path")
            into = into.unionByName(blocks.where(F.col("n") > SPAN).join(lower, ["tree", "block"]))
        found = _segments(into)
        if blocks is not layers[0]:
            found = stored(found, "merkle-paths")
    return found


def merkle_proofs(leaves: DataFrame) -> DataFrame:
    """``load, leaf, subroot, root, proof`` from ``tree, place, leaf, load``.

    ``tree`` is a non-null string, trees hang under the root in its order; ``place`` orders the leaves
    of a tree, equal places are ordered by their leaf.  ``load`` is any column to carry along.
    ``proof`` runs from the leaf up to the root: per level the place of the node in its run and the
    digests of the others, left to right.
    """
    ordered = ranked(leaves, [F.col("place").asc_nulls_first(), F.col("leaf")], "tree", size="n")
    nodes = stored(ordered.select("tree", "n", "rank", F.col("leaf").alias("digest"), "load"), "merkle-leaves")
    layers = _build(nodes, nodes.agg(F.max("n")).first()[0] or 0)
    # The tree over the trees: its leaves are the tops, its load their names.
    tops = _tops(layers).select(F.lit("").alias("root_tree"), F.col("tree").alias("load"), F.col("top").alias("digest"))
    named = ranked(tops, [F.col("load")], "root_tree", size="n")
    upper = stored(named.select(F.col("root_tree").alias("tree"), "n", "rank", "digest", "load"), "merkle-tops")
    upper_layers = _build(upper, upper.agg(F.max("n")).first()[0] or 0)
    root = _tops(upper_layers).select("tree", F.struct(F.col("top").alias("root"), F.lit(None).cast("string").alias("subroot")).alias("base"))
    start = root.withColumn("path", F.array().cast(_PATH))
    down = _descend(upper_layers, start).select(
        F.col("load").alias("tree"), F.struct(F.col("base.root"), F.col("digest").alias("subroot")).alias("base"), "path"
    )
    found = _descend(layers, stored(down, "merkle-subroots"))
    return found.select(
        "load", F.col("digest").alias("leaf"), F.col("base.subroot").alias("subroot"), F.col("base.root").alias("root"),
        F.reverse("path").alias("proof"),
    )


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""

    def up(node: Column, step: Column) -> Column:
        others = step["siblings"]
        left = F.array_join(F.slice(others, F.lit(1), step["place"]), "")
        right = F.array_join(F.slice(others, step["place"] + 1, F.lit(ARITY)), "")
        return F.sha2(F.concat(left, node, right), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda step: step["siblings"])), ""), 256)


def merkle_manifest(
    documents: DataFrame, fields: list[str], altered: dict[str, Column] | None = None, tree: str = "source", place: str = "doc_id"
) -> DataFrame:
    """``<place>, leaf, subroot, root, proof, folded_root, verified`` of every row.

    A leaf digests the named ``fields``.  Rows are verified as they are, or with the fields in
    ``altered`` replaced by expressions over the documents: the altered row is folded up with the
    original proof.  Nulls are told from empty values; a null ``tree`` comes first and is a tree of its
    own, a null ``place`` comes first in its tree; equal rows are leaves of their own.  Other columns
    are not part of a leaf.  An empty table gives an empty result.
    """
    value = {f: F.col(f"`{f}`") for f in fields}
    leaves = documents.select(
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{tree}`").cast("string")), F.lit("-")).alias("tree"),
        F.col(f"`{place}`").alias("place"),
        row_digest(list(value.values())).alias("leaf"),
        F.struct(
            F.col(f"`{place}`").alias("place"), row_digest(list((value | (altered or {})).values())).alias("altered")
        ).alias("load"),
    )
    # Stored, so that finding the bounds of the ranges does not digest all texts once more.
    proved = merkle_proofs(stored(leaves, "merkle-digests"))
    folded = proved.withColumn("folded_root", fold_proof(F.col("load.altered"), F.col("proof")))
    return folded.select(
        F.col("load.place").alias(place), "leaf", "subroot", "root", "proof", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
