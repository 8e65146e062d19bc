"""Exact dedup by content-defined chunk recipes.

A gear rolling hash cuts each text where its content says so. Chunks are deduplicated to verified
identifiers: a digest stands for a chunk only after all chunks with that digest were compared byte by
byte; chunks that share a digest without being equal get ordinals. A document then is an ordered list
of identifiers, some 8 bytes per KB, and only these lists are grouped and joined. A long text leaves
its task once, as chunks for verification, however many copies there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.memory import lean
from foliant.llm.sieve import without
from foliant.runtime import materialize

MIN_CHUNK, CHUNK_BITS, MAX_CHUNK, WINDOW = 256, 10, 16_384, 32
_GEAR = np.random.default_rng(20_240_601).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPAN = 1 << 22


def digest64(chunk: bytes) -> int:
    """Signed 64-bit digest of a chunk."""
    h = xxhash.xxh3_64_intdigest(chunk)
    return h - (1 << 64) if h >> 63 else h


def _candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which the 32-byte gear hash allows a cut, found in spans of bounded memory."""
    out = []
    for at in range(0, len(data), _SPAN):
        lo = max(0, at - WINDOW + 1)
        h = _GEAR[data[lo : at + _SPAN]]
        for s in (1, 2, 4, 8, 16):
            h[s:] += h[:-s] << np.uint32(s)
        hit = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + lo
        out.append(hit[hit >= at])
    return np.concatenate(out) + 1 if out else np.empty(0, np.int64)


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Chunk borders of each document in a flat byte buffer; equal contents get equal borders."""
    cuts = _candidates(data)
    lo = np.searchsorted(cuts, offsets[:-1], "right")
    hi = np.searchsorted(cuts, offsets[1:], "left")
    bounds = []
    for start, end, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lo.tolist(), hi.tolist()):
        own, last = [start], start
        for c in cuts[i:j].tolist() if end - start > MIN_CHUNK else ():
            while c - last > MAX_CHUNK:
                last += MAX_CHUNK
                own.append(last)
            if c - last >= MIN_CHUNK:
                own.append(c)
                last = c
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            own.append(last)
        if end > start:
            own.append(end)
        bounds.append(own)
    return bounds


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, memoryview]:
    text = batch.column("text").cast(pa.large_binary())
    _, offs, data = text.buffers()
    offsets = np.frombuffer(offs, np.int64)[text.offset : text.offset + len(text) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    flat = flat[base : int(offsets[-1])] if len(offsets) else flat
    return flat, offsets - base, memoryview(flat)


def _recipes(digest: Callable[[bytes], int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offsets, view = _flat(batch)
            recipes = [
                [digest(view[a:b]) for a, b in zip(own, own[1:])] for own in chunk_bounds(flat, offsets)
            ]
            shas = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.int64()))],
                ["doc_id", "text_sha256", "recipe"],
            )

    return run


def _chunks(digest: Callable[[bytes], int], whole: bool) -> Callable:
    """Chunks once per batch; with ``whole`` every occurrence, with its document and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offsets, view = _flat(batch)
            bounds = chunk_bounds(flat, offsets)
            if whole:
                rows = [
                    (i, k, bytes(view[a:b])) for i, own in enumerate(bounds) for k, (a, b) in enumerate(zip(own, own[1:]))
                ]
                docs, pos, chunks = zip(*rows) if rows else ((), (), ())
                take = pa.array(docs, pa.int64())
                head = [
                    batch.column("doc_id").take(take), batch.column("text_sha256").take(take),
                    pa.array(pos, pa.int32()),
                ]
                names = ["doc_id", "text_sha256", "pos", "h", "chunk"]
            else:
                chunks = list({bytes(view[a:b]) for own in bounds for a, b in zip(own, own[1:])})
                head, names = [], ["h", "chunk"]
            hashes = pa.array([digest(c) for c in chunks], pa.int64())
            yield pa.RecordBatch.from_arrays([*head, hashes, pa.array(chunks, pa.binary())], names)

    return run


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def dedup_groups(docs: DataFrame, digest: Callable[[bytes], int] = digest64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Two texts are one group when their bytes are equal; a null text counts as empty. ``keep_id`` is
    the largest doc_id of the group (null ids are smallest; a group of null ids keeps null).
    Rows that repeat both id and text share their verdict; :func:`drop_duplicates` then keeps one of
    them. Other columns are not read. An empty table gives an empty table.
    """
    plain = _plain(docs)
    recipes = materialize(
        plain.mapInArrow(lean(_recipes(digest)), "doc_id long, text_sha256 string, recipe array<long>"), "recipes"
    )
    chunks = plain.mapInArrow(lean(_chunks(digest, False), "text"), "h long, chunk binary").distinct()
    shared = chunks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = materialize(shared, "collided")
    if shared.isEmpty():
        keyed = recipes.withColumn("ordinals", F.lit(None).cast("array<int>"))
    else:
        keyed = _with_ordinals(docs, recipes, chunks, shared, digest)
    groups = keyed.groupBy("recipe", "ordinals").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    same = (F.col("d.recipe") == F.col("g.recipe")) & F.col("d.ordinals").eqNullSafe(F.col("g.ordinals"))
    return keyed.alias("d").join(groups.alias("g"), same).select(
        "d.doc_id", "g.keep_id", "g.group_size", F.col("d.doc_id").eqNullSafe(F.col("g.keep_id")).alias("kept"),
        "d.text_sha256", F.size("d.recipe").cast("long").alias("n_chunks"),
    )


def _with_ordinals(docs, recipes, chunks, shared, digest) -> DataFrame:
    """Tell apart unequal chunks that share a digest: their identifier is (digest, ordinal)."""
    ordinal = F.row_number().over(W.partitionBy("h").orderBy("chunk"))
    table = chunks.join(shared, "h").withColumn("ordinal", ordinal)
    touched = (
        recipes.select("doc_id", "text_sha256", F.explode("recipe").alias("h")).join(shared, "h")
        .select("doc_id", "text_sha256").distinct()
    )
    texts = _plain(docs).withColumn("text_sha256", F.sha2("text", 256))
    on = (texts.doc_id.eqNullSafe(touched.doc_id)) & (texts.text_sha256 == touched.text_sha256)
    texts = texts.join(touched, on, "left_semi").dropDuplicates(["doc_id", "text_sha256"])
    schema = "doc_id long, text_sha256 string, pos int, h long, chunk binary"
    lists = (
        texts.mapInArrow(lean(_chunks(digest, True), "text"), schema).join(table, ["h", "chunk"], "left")
        .groupBy("doc_id", "text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("ordinal", F.lit(0)).alias("o")))).alias("l"))
        .select("doc_id", "text_sha256", F.col("l.o").alias("ordinals"))
    )
    on = recipes.doc_id.eqNullSafe(lists.doc_id) & (recipes.text_sha256 == lists.text_sha256)
    return recipes.join(lists, on, "left").select(recipes["*"], lists.ordinals)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`dedup_groups` drops, all columns kept.

    Of rows that repeat both id and text one stays. Null texts count as empty, so one of all null and empty
    texts stays; columns may have any names. Only texts that a sieve of the rows to drop cannot clear are shuffled.
    """
    verdict = materialize(dedup_groups(docs).select("doc_id", F.unhex("text_sha256").alias("sha"), "kept"), "verdict")
    gone = verdict.where("not kept").select("doc_id", "sha").distinct()
    again = verdict.where("kept").groupBy("doc_id", "sha").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "sha")
    again = materialize(again, "again")
    repeated = not again.isEmpty()
    out = materialize((gone.union(again) if repeated else gone).withColumn("h", F.xxhash64("doc_id", "sha")), "gone")
    sha = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    text_sha = lambda r: F.unhex(F.sha2(F.coalesce(r["text"], F.lit("")), 256))
    same = lambda r, g: r["doc_id"].eqNullSafe(g("doc_id")) & (text_sha(r) == g("sha"))
    kept = without(docs, F.xxhash64(docs["doc_id"].cast("long"), sha), out, out.count(), same)
    if repeated:
        more = again.select(F.col("doc_id").alias("g_id"), F.col("sha").alias("g_sha"))
        among = docs["doc_id"].eqNullSafe(more["g_id"]) & (sha == more["g_sha"])
        kept = kept.unionByName(docs.join(more, among, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_groups(docs).drop("n_chunks")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
