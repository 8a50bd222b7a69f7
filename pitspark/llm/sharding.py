"""Minimax contiguous partition of documents into shards of near-equal bytes.

Equal texts form an atomic group. Groups lie in the order of their 64-bit text
hash (two texts that share a hash only travel together). The smallest capacity
for which greedy filling needs no more than the given shards is found by binary
search; the cuts are where that greedy filling cuts.

A group larger than its fair share would stretch the capacity for all others,
so such groups (fewer than the shard count, by pigeonhole) come first in the
order and get a shard each; the rest is partitioned over the shards left.

The search never sees all groups: it works on contiguous cells of hash space
(a bounded number of sums) and splits only those cells in which the cuts of an
optimal greedy filling can lie, until these hold one group each. With capacity
C feasible and total W over k shards, cut j lies in [W - (k-j)C, jC]; cells
outside of these intervals can stay whole without changing the result.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
_FIRST_BITS, _MORE_BITS = 14, 6
_ALL_BEFORE = -(2**63)


def _greedy(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Indices of the cells that begin a new shard, or None if the cells don't fit. sums: prefix sums with a leading 0."""
    cuts, at, last = [], 0, len(sums) - 1
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity) - 1
        if at >= last:
            return cuts
        cuts.append(at)
    return None


def minimax(weights: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity over ordered atomic weights, and the greedy cuts at it."""
    sums = [0, *accumulate(weights)]
    low, high = max([0, *weights, -(-sums[-1] // shards)]), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(sums, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, _greedy(sums, low, shards) or []


def _cuts(light: DataFrame, shards: int) -> list[int]:
    """Hash values at which a new shard begins; light: (key, bytes, n_rows), a row for each group."""
    bits = _FIRST_BITS
    width = lambda b: 64 - b
    found = light.groupBy(F.shiftright("key", width(bits)).alias("c")).agg(F.sum("bytes").alias("w"), F.count("*").alias("n")).collect()
    cells = sorted((r["c"] << width(bits), r["w"], r["n"]) for r in found)  # at most 2 ** _FIRST_BITS
    while cells:
        capacity, cuts = minimax([w for _, w, _ in cells], shards)
        sums = [0, *accumulate(w for _, w, _ in cells)]
        zones = [(sums[-1] - (shards - j) * capacity, j * capacity) for j in range(1, shards)]
        split = sorted({i for a, b in zones for i in range(max(0, bisect_right(sums, a) - 1), min(len(cells), bisect_right(sums, b))) if cells[i][2] > 1})
        if not split or bits >= 62:
            return [cells[i][0] for i in cuts]
        # only cells of the finest width are split again: all others were found outside of the zones
        spark = light.sparkSession
        wanted = spark.createDataFrame([(cells[i][0] >> width(bits),) for i in split], "c long")
        fine = light.withColumn("c", F.shiftright("key", width(bits))).join(F.broadcast(wanted), "c")  # some 40 cells a cut
        more = min(62, bits + _MORE_BITS)
        found = fine.groupBy(F.shiftright("key", width(more)).alias("f")).agg(F.sum("bytes").alias("w"), F.count("*").alias("n")).collect()
        gone = set(split)
        cells = sorted([x for i, x in enumerate(cells) if i not in gone] + [(r["f"] << width(more), r["w"], r["n"]) for r in found])
        bits = more
    return []


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 1000) -> DataFrame:
    """A row for each input row: id, size, text_crc32, law, shard, slot, grown_shard, text_key.

    Law ``bytes``: the largest shard is as small as the order of atomic groups allows. size is the text's UTF-8 bytes plus
    16. Null and empty texts are one group without bytes of text. Repeated rows stay, each with a slot of its own; slots
    run without gaps from 0 in each shard. An empty table gives an empty result. Other columns of the input are not
    carried, so their names can't clash. grown_shard is null: only a law by key has one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_key"))
    groups = stage(rows.groupBy(F.col("text_key").alias("key")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows")), "groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    heavy, rest, left = [], total, shards
    for g in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if left == 1 or g["bytes"] * left <= rest:
            break
        heavy.append(g)
        rest, left = rest - g["bytes"], left - 1
    alone = [g["key"] for g in heavy]
    cuts = _cuts(groups.filter(~F.col("key").isin(alone)) if alone else groups, left)
    shard = F.lit(len(alone))
    for cut in cuts:
        shard = shard + (F.col("text_key") >= F.lit(cut)).cast("int")
    for k, key in enumerate(alone):
        shard = F.when(F.col("text_key") == F.lit(key), F.lit(k)).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))

    # slots: shards are dealt into parts of about slot_rows rows, numbered within each part and offset by the parts before
    in_shard = groups.withColumnRenamed("key", "text_key").withColumn("shard", shard.cast("int")).groupBy("shard").agg(F.sum("n_rows").alias("n")).collect()  # a row a shard
    parts = {r["shard"]: -(-r["n"] // slot_rows) for r in in_shard}
    n_parts = F.element_at(F.array(*[F.lit(parts.get(s, 1)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(1)), n_parts))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(_window("shard", order=("part",)).rowsBetween(_ALL_BEFORE, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    number = F.row_number().over(_window("shard", "part", order=("doc_id", "text_key", "size")))
    return placed.withColumn("n", number).join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "text_key")


def _window(*by: str, order: tuple[str, ...]):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over 40 shards."""
    return shard_documents(table(spark, sf_dir, "documents")).drop("text_key")
