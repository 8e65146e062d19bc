"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every row has a place on a 64-bit ring (the hash of its text, so copies lie side by side) and belongs to
the arc that ends at the next virtual node clockwise. Shards have capacities that add up to at least all
rows. A shard first takes the rows of its own arcs; what does not fit continues clockwise to the next
virtual node whose shard has room. Because that walk needs only the row counts of the arcs, it runs over
``shards * replicas`` numbers on the driver, whatever the size of the input. The rows then find their
place by their rank within the arc.

Ranks are distributed too: an arc is cut in buckets by a hash of the row, so that an arc which holds a
third of all rows (one text, many copies) is ranked by many tasks; bucket sizes are summed up first and
rows are numbered within their bucket only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS, REPLICAS, CELLS, BUCKET_ROWS = 16, 64, 256, 2_000


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes; positions are signed 64-bit."""
    def place(s: int, r: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{s}/{r}".encode(), digest_size=8).digest(), "big", signed=True)

    return sorted((place(s, r), s) for s in range(shards) for r in range(replicas))


def arc_of(position: Column, nodes: list[tuple[int, int]]) -> Column:
    """Index of the first virtual node at or after ``position``, clockwise.

    The ring is cut in 256 cells; a cell's few nodes and the number of nodes before it are literals.
    """
    cells: list[list[int]] = [[] for _ in range(CELLS)]
    for at, _ in nodes:
        cells[(at >> 56) + CELLS // 2].append(at)
    before, n = [], 0
    for c in cells:
        before.append(n)
        n += len(c)
    cell = (F.shiftright(position, 56) + CELLS // 2 + 1).cast("int")
    lits = F.array(*[F.array(*map(F.lit, c)) if c else F.array().cast("array<bigint>") for c in cells])
    inside = F.size(F.filter(F.element_at(lits, cell), lambda x: x < position))
    return (F.element_at(F.array(*map(F.lit, before)), cell) + inside) % len(nodes)


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Largest row count of each shard: at most one apart, ``slack`` above the even share."""
    room = int(rows * (1 + slack))
    return [room // shards + (s < room % shards) for s in range(shards)]


def deal(counts: dict[int, int], nodes: list[tuple[int, int]], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of each arc go where.

    Own arcs first, in ring order, then the overflow clockwise; every number stays below ``caps``.
    """
    left, slot, out, over = list(caps), [0] * len(caps), [], []

    def put(arc: int, at: int, n: int, shard: int) -> None:
        out.append((arc, at, at + n, shard, slot[shard]))
        slot[shard] += n
        left[shard] -= n

    for arc, (_, shard) in enumerate(nodes):
        n = counts.get(arc, 0)
        own = min(n, left[shard])
        if own:
            put(arc, 0, own, shard)
        if n > own:
            over.append((arc, own, n))
    for arc, at, n in over:
        step = arc
        while at < n:
            shard = nodes[step % len(nodes)][1]
            if part := min(n - at, left[shard]):
                put(arc, at, part, shard)
                at += part
            step += 1
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS, slack: float = 0.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    With ``slack`` 0 the row counts of the shards are at most one apart (law ``rows``). ``slot`` numbers
    a shard's rows from 0 without gaps. Equal texts share a ring position and stay together until a
    shard is full. A null text has size 1 and is placed like an empty one; null and repeated ids are
    ordinary rows. Ranks order rows by bucket, then doc_id, then text; rows equal in all of these are
    interchangeable. An empty table gives an empty table. Other columns are not read.
    """
    spark, nodes = docs.sparkSession, ring(shards, replicas)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("position"),
    ).withColumn("arc", arc_of(F.col("position"), nodes))
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    plan = deal(counts, nodes, capacities(total, shards, slack))
    buckets = max(1, -(-total // (len(nodes) * BUCKET_ROWS)))
    largest = max(counts.values(), default=0)
    buckets = max(buckets, -(-largest // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "position", F.lit(7)), F.lit(buckets)))
    sizes = rows.groupBy("arc", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("arc").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("arc", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("arc", "bucket").orderBy("doc_id", "position", "text_crc32")
    ranked = (
        rows.withColumn("r", F.row_number().over(within) - 1).join(starts, ["arc", "bucket"])
        .withColumn("rank", F.col("start") + F.col("r"))
    )
    parts = spark.sql(
        "SELECT * FROM VALUES " + ",".join(f"({a},{b}L,{c}L,{s},{d}L)" for a, b, c, s, d in plan or [(-1, 0, 0, 0, 0)])
        + " AS t(p_arc, lo, hi, shard, first_slot)"
    )  # at most one part for each arc and two for each shard
    on = (F.col("arc") == F.col("p_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(parts), on).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
