"""Operator 6: shards from fixed virtual slots.

A record's key is hashed into one of thousands of slots, which never changes.
Rows and bytes are summed per slot, and a versioned map says which shard holds
which slot. Version 0 deals slots out in turn; ``rebalance`` makes a new version
by moving single slots from the fullest to the emptiest shard until no move
makes the sizes more equal; ``grow`` makes one that moves slots only into a new
shard. Each version of the map has at most a few tens of thousands of rows whatever the input.
A stored map is edited, not built anew: ``assign`` takes it, lets its last version
grow by the shards that were added, rebalances that by the bytes of now and adds
the result as one more version; ``moves`` says which slots that moved.

A slot that holds far more than its share (one key may hold a third of all rows)
is split into parts by the row's number in the table; the parts are slots of
their own in the map. A stored map's parts stay as they are while they are enough;
a row may move between the parts of its slot, as it has no key of its own there.

Defined results: a null text has no bytes and the checksum of the empty text; a
null key is a key like any other; repeated rows each get a place; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import written

SLOTS = 16384
#: Each record counts so many bytes besides its text.
RECORD_BYTES = 8
#: A slot over this part of a shard's share is split into parts of half that size.
HOT_PART = 0.25


def records(docs: DataFrame, slots: int = SLOTS, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, row) of every record; no text goes further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("bigint") + RECORD_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("virtual_slot"), F.monotonically_increasing_id().alias("row"))


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes by slot; as many entries as the map at most."""
    found = rows.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    return {r["virtual_slot"]: (r["n"], r["b"]) for r in found}


def hot_parts(sizes: dict[int, tuple[int, int]], shards: int, slots: int, known: dict[int, range] | None = None) -> dict[int, range]:
    """The parts of each slot over HOT_PART of a shard's share, numbered from ``slots`` on; ``known`` ones stay if they are enough."""
    part = sum(b for _, b in sizes.values()) / shards * HOT_PART
    parts = dict(known or {})
    hot = {s: int(b / part * 2) + 1 for s, (n, b) in sizes.items() if b > part and n > 1}  # shards / HOT_PART at most
    at = max([slots, *(r.stop for r in parts.values())])
    for s in sorted(hot):
        if len(parts.get(s, ())) < hot[s]:
            parts[s] = range(at, at + hot[s])
            at += hot[s]
    return parts


def split_hot(rows: DataFrame, parts: dict[int, range]) -> DataFrame:
    """The rows with those of each slot in ``parts`` dealt over its parts."""
    if not parts:
        return rows
    first, hot = {s: r.start for s, r in parts.items()}, {s: len(r) for s, r in parts.items()}
    flat = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])[F.col("virtual_slot")]
    return rows.withColumn("virtual_slot", F.coalesce(flat(first) + F.pmod(F.xxhash64("row"), flat(hot)), "virtual_slot"))


def first_map(slots: list[int], shards: int) -> dict[int, int]:
    return {s: s % shards for s in slots}


def rebalance(slot_map: dict[int, int], size: dict[int, int], shards: int) -> dict[int, int]:
    """A new version: slots move from the fullest shard to the emptiest while that makes them more equal."""
    new, pieces, load = dict(slot_map), [[] for _ in range(shards)], [0] * shards
    for s, b in sorted(size.items(), key=lambda x: (x[1], x[0])):  # small slots first
        load[new[s]] += b
        pieces[new[s]].append((b, s))
    while True:
        full, free = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap, own = load[full] - load[free], pieces[full]
        low, high = 0, len(own)
        while low < high:  # the largest slot of at most half the gap, or else the next one if it still helps
            mid = (low + high) // 2
            low, high = (mid + 1, high) if 2 * own[mid][0] <= gap else (low, mid)
        at = low - 1 if low else 0
        if not own or own[at][0] >= gap:
            return new
        b, s = own.pop(at)
        new[s] = free
        load[full] -= b
        load[free] += b
        bisect.insort(pieces[free], (b, s))


def grow(slot_map: dict[int, int], shards: int) -> dict[int, int]:
    """A new version for one more shard: each shard gives an equal part of its slots to the new one, and nothing else moves."""
    new, by = dict(slot_map), defaultdict(list)
    for s in sorted(slot_map):
        by[slot_map[s]].append(s)
    for own in by.values():
        for s in own[shards::shards + 1]:
            new[s] = shards
    return new


def last_version(stored: DataFrame) -> tuple[int, dict[int, int], dict[int, range]]:
    """The number, the map and the hot slots' parts of a stored map's last version."""
    rows = stored.join(F.broadcast(stored.agg(F.max("version").alias("version"))), "version").collect()  # one version
    parts: dict[int, list[int]] = defaultdict(list)
    for r in rows:
        if r["part_of"] is not None:
            parts[r["part_of"]].append(r["virtual_slot"])
    return rows[0]["version"], {r["virtual_slot"]: r["shard"] for r in rows}, {s: range(min(p), max(p) + 1) for s, p in parts.items()}


def edited(slot_map: dict[int, int], parts: dict[int, range], shards: int) -> dict[int, int]:
    """A stored map for ``shards`` shards and the ``parts`` of now: slots leave shards that are gone, new shards take equal parts."""
    new = {s: k if k < shards else s % shards for s, k in slot_map.items()}
    for have in range(max(new.values()) + 1, shards):
        new = grow(new, have)
    for own in parts.values():
        new.update((s, s % shards) for s in own if s not in new)
    return new


def moves(kept: DataFrame) -> DataFrame:
    """(virtual_slot, old_shard, new_shard) of the slots that the last version of a map moved."""
    last = F.col("last")
    pair = kept.agg(F.max("version").alias("last")).select(F.explode(F.array(last - 1, last)).alias("version"), "last")  # two rows
    found = kept.join(F.broadcast(pair), "version")
    of = lambda past: F.max(F.when(F.col("version") == last - past, F.col("shard")))
    return found.groupBy("virtual_slot").agg(of(1).alias("old_shard"), of(0).alias("new_shard")).where("old_shard <> new_shard")


def store(spark: SparkSession, versions: list[dict[int, int]], sizes: dict[int, tuple[int, int]], parts: dict[int, range], number: int = 0) -> DataFrame:
    """The versions from ``number`` on as rows (version, slot, shard, n_rows, n_bytes, first, part_of): first is the place of the slot's
    first row in its shard, part_of the slot whose part it is."""
    out, whole = [], {s: slot for slot, own in parts.items() for s in own}
    for version, m in enumerate(versions, number):
        at: dict[int, int] = defaultdict(int)
        for s in sorted(m):
            n, b = sizes.get(s, (0, 0))
            out.append((version, s, m[s], n, int(b), at[m[s]], whole.get(s)))
            at[m[s]] += n
    schema = "version int, virtual_slot bigint, shard int, n_rows bigint, n_bytes bigint, first bigint, part_of bigint"
    return spark.createDataFrame(out, schema)


def assign(docs: DataFrame, shards: int = 24, slots: int = SLOTS, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text",
           stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every record's shard and place, and the versioned map: ((doc_id, size, text_crc32, virtual_slot, shard, place), map).
    ``stored`` is the map of an earlier call with the same slots and keys; it is returned with one more version."""
    spark, rows = docs.sparkSession, written(records(docs, slots, keys, text_col), "records")
    sizes = slot_sizes(rows)
    number, held, known = last_version(stored) if stored is not None else (-1, None, {})
    parts = hot_parts(sizes, shards, slots, known)
    cut = split_hot(rows, parts)
    if cut is not rows:
        rows, sizes = cut, slot_sizes(cut)
    start = first_map([*range(slots), *(s for s in sizes if s >= slots)], shards) if held is None else edited(held, parts, shards)
    new = rebalance(start, {s: b for s, (_, b) in sizes.items()}, shards)
    versions = [start, new] if held is None else [new]
    kept = store(spark, versions, sizes, parts, number + 1)
    kept = written(kept if stored is None else stored.unionByName(kept), "slot-map")
    number += len(versions)
    current = kept.where(F.col("version") == number).select("virtual_slot", "shard", "first")
    in_slot = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "row"))
    placed = rows.withColumn("number", in_slot).join(F.broadcast(current), "virtual_slot")  # the slots, and 3 * shards / HOT_PART parts
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("number") - 1).alias("place")), kept
