"""Operator 2: SimHash near-duplicates by multi-index hashing.

Fingerprints: XXH64 of every word shingle, one vote a bit. Links: each 64-bit
fingerprint is cut into segments; two fingerprints within ``max_bits`` differ by
at most ``max_bits // segments`` bits in one segment at least. So every
fingerprint is filed in one table per segment under its value there, each
enumerates the small Hamming ball around its own segment values, and the
matches are verified on all 64 bits. Equal fingerprints are one node, so a group
of copies costs one row here whatever its size.

A table entry shared by very many fingerprints (a hot segment value) is refiled
by the rest of the bits: under (value, half a segment) with a ball around each
half, verified likewise. No entry is capped and no link is lost.

Defined results: a null text counts as an empty one; a text without words has
fingerprint zero; a null doc_id keeps its row and is never a component id while
another id can be reached; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices, written

SEED = 42
#: Shingles that are turned into bits at a time.
STEP = 1 << 15


def fingerprint(text: str | None, words: int) -> int:
    """The unsigned 64-bit SimHash of one text."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    if len(found) <= words:
        return xxh64_intdigest(b" ".join(found), SEED)
    hashes = np.array([xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(found[i:] for i in range(words))))], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at:at + STEP]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. No shuffle."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, fp bigint")


#: Fingerprints under one table entry beyond which the entry is refiled by the rest of their bits.
HOT_ENTRY = 1000


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` set."""
    masks, last = [0], [0]
    for _ in range(radius):
        last = sorted({m | 1 << i for m in last for i in range(width) if not m >> i & 1})
        masks += last
    return masks


def segment(fp, number: int, width: int):
    return F.shiftrightunsigned(fp, number * width).bitwiseAND(F.lit((1 << width) - 1))


def filed(fps: DataFrame, segments: int, width: int) -> DataFrame:
    """A table entry for every fingerprint and segment: (key, fp)."""
    keys = [segment(F.col("fp"), s, width) + F.lit(s << width) for s in range(segments)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def probes(entries: DataFrame, width: int, radius: int) -> DataFrame:
    """The keys in the ball around each entry. Of two fingerprints that differ in a mask, the one
    whose lowest bit there is unset probes, so each pair is met once."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in ball(width, radius)])
    ask = F.filter(masks, lambda m: F.col("key").bitwiseAND(m).bitwiseAND(-m) == 0)
    return entries.select(F.col("fp").alias("a"), "key", F.explode(ask).alias("mask")).select(
        "a", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), (F.col("mask") == 0).alias("same"))


def links(fps: DataFrame, max_bits: int, segments: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints in ``fps`` that differ in 1 to ``max_bits`` bits, each once.

    Probes and entries are joined by a shuffle, as the hints ask: Spark takes an exploded table to be as small as the
    one it comes from, and would gather some 35 probes a fingerprint on the driver. The hot entries are joined by semi
    joins, in which only they can be broadcast."""
    if 64 % segments or segments < 2:
        raise ValueError("segments must divide 64 and be two at least")
    width, radius = 64 // segments, max_bits // segments
    entries = filed(fps, segments, width)
    table = entries.withColumnRenamed("fp", "b")
    asked = probes(entries, width, radius)
    hot = written(table.groupBy("key").count().where(F.col("count") > HOT_ENTRY).select("key"), "hot-entries")
    if hot.isEmpty():
        met = asked.join(table.hint("merge"), "key")
    else:  # the same tables for the other bits, below each hot entry
        half = width // 2
        parts = range(64 // half)
        radius_below = max_bits // (len(parts) - 2)
        outside = F.floor(F.col("part.p") / 2) != F.shiftright(F.col("key"), width)
        near = F.array(*[F.lit(m).cast("bigint") for m in ball(half, radius_below)])
        own = F.array(*[F.struct(F.lit(p).alias("p"), segment(F.col("b"), p, half).alias("v")) for p in parts])

        def about(p: int):
            return F.transform(near, lambda m: F.struct(F.lit(p).alias("p"), segment(F.col("a"), p, half).bitwiseXOR(m).alias("v")))

        around = F.flatten(F.array(*map(about, parts)))
        sub = table.join(hot, "key", "left_semi").select("key", "b", F.explode(own).alias("part")).where(outside)
        below = asked.join(hot, "key", "left_semi").select("a", "key", "same", F.explode(around).alias("part")).where(outside)
        below = below.join(sub.hint("merge"), ["key", "part"]).select("key", "a", "same", "b").distinct()
        met = asked.join(hot, "key", "left_anti").join(table.hint("merge"), "key").unionByName(below)
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    at = F.shiftright(F.col("key"), width)
    earlier = F.lit(True)
    for s in range(segments):  # a pair counts in the first segment that could give it
        apart = F.bit_count(segment(F.col("a"), s, width).bitwiseXOR(segment(F.col("b"), s, width)))
        earlier &= (at <= s) | (apart > radius)
    return met.where((differ > 0) & (differ <= max_bits) & (~F.col("same") | (F.col("a") < F.col("b"))) & earlier).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); the label is the component's smallest node.
    Each round takes the neighbours' smallest label, then the label's own label; each is a written table."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, segments: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint and component: (doc_id, fp, component_id); the component id is the smallest
    doc_id that can be reached over fingerprints within ``max_bits``, the row's own included."""
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = written(links(nodes.select("fp"), max_bits, segments), "links")
    if found.isEmpty():
        return rows.join(nodes, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))
    labels = components(found)
    named = nodes.join(labels, nodes.fp == labels.node).select("fp", "label", "first")
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    named = named.join(heads, "label").select("fp", "head")
    # written, so that the last join is one of two plain shuffles, in which Spark splits a fingerprint with very many rows
    ids = written(nodes.join(named, "fp", "left").select("fp", F.coalesce("head", "first").alias("component_id")), "ids")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one with the smallest doc_id, null last, then text hash.
    A row is known by both, so a null or repeated doc_id is compared like any other; rows equal in both are one text."""
    def free(name: str) -> str:
        """A column name that ``docs`` doesn't have."""
        return name if name not in docs.columns else free(name + "_")

    bare = F.col("doc_id").isNull()
    parts = {"bare": bare, "id": F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)), "h": F.xxhash64("text")}
    whole = docs.select(F.struct(*[c.alias(n) for n, c in parts.items()]).alias("key"), "text")
    heads = near_duplicates(whole, words, max_bits, id_col="key").select(*[F.col(f"component_id.{n}").alias(f"__head_{n}") for n in parts]).distinct()
    # plain columns, since structs that differ in nullability are cast and so shuffled again; repeated rows are cut down
    # within each task, whole rows are shuffled once by their key, and the join finds them there
    names = {n: free(f"__{n}") for n in parts}
    rows = docs.withColumns({names[n]: c for n, c in parts.items()})
    place, order = free("__place"), Window.partitionBy(*names.values()).orderBy(F.xxhash64("text"))
    one = rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    heads = heads.select(*[F.col(f"__head_{n}").alias(names[n]) for n in parts])
    return one.join(heads, list(names.values()), "left_semi").drop(place, *names.values()).select(*docs.columns)
