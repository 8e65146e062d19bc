"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Distinct pre-tokens are rows of matrices, one matrix for each bucket of byte lengths, padded with -1. In
every round each row merges its leftmost pair of minimum rank; the rank of a pair comes from a hash table
in numpy arrays, and removing one cell from each row compacts the matrix by one column. Rows without a
mergeable pair leave it. Only the two pairs beside a merge are looked up again. A pre-token of more than LONG
bytes is a matrix of its own, one row, whose rounds would grow with its length: a round takes all the merges at
once that the rule would make one after the other, that is, those of the minimum rank from the left, up to the
first that brings forth a pair of a lower rank.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.memory import lean
from foliant.llm.pretoken import WordCache, encode_texts

BUCKETS, LONG, ROWS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256, 512, 1024), 1024, 1 << 16
#: words that a task keeps the ids of, and bytes of texts that it takes at a time
WORDS, SLICE = 200_000, 1 << 20
NONE = np.int32(2**31 - 1)


class BpeTable:
    """Ranks of byte strings, and the rank of every pair of ranks whose join has one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), 1
        left = np.array(list(pairs), np.int64)
        values = np.array(list(pairs.values()), np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == -1
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.values[slot[one]] = left[one], values[one]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, values, slot = left[rest], values[rest], (slot[rest] + 1) & (size - 1)
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is none; padding (-1) on either side has none."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1) & (keys != -2))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            at = slot[open_]
            hit = self.keys[at] == keys[open_]
            found[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.keys[at] != -1)]
        return found

    def merge_matrix(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged rows, padded with -1, and their lengths."""
        n, width = rows.shape
        out, out_len = np.full((n, width), -1, np.int32), lengths.copy()
        m, who = rows, np.arange(n)
        ranks = self.rank(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(n, -1) if width > 1 else np.full((n, 0), NONE)
        while True:
            k = len(who)
            if m.shape[1] > 1 and k:
                at = ranks.argmin(1)
                best = ranks[np.arange(k), at]
                done = best == NONE
            else:
                done = np.ones(k, bool)
            if done.any():
                gone = who[done]
                out[gone, : m.shape[1]] = m[done]
                if done.all():
                    return out, out_len
                keep = ~done
                m, ranks, who, at, best = m[keep], ranks[keep], who[keep], at[keep], best[keep]
                k = len(who)
            out_len[who] -= 1
            r, w = np.arange(k), m.shape[1]
            m[r, at] = best
            drop = np.ones((k, w), bool)
            drop[r, at + 1] = False
            m = m[drop].reshape(k, w - 1)
            drop = np.ones((k, w - 1), bool)
            drop[r, at] = False
            ranks = ranks[drop].reshape(k, w - 2)
            has = at > 0
            ranks[r[has], at[has] - 1] = self.rank(m[r[has], at[has] - 1], m[r[has], at[has]])
            has = at < w - 2
            ranks[r[has], at[has]] = self.rank(m[r[has], at[has]], m[r[has], at[has] + 1])

    def merge_row(self, row: np.ndarray) -> np.ndarray:
        """One long row merged; a round takes as many merges as follow each other by the rule."""
        ranks = self.rank(row[:-1], row[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # of occurrences that overlap, every other one from the left
            turn = np.ones(len(at), bool)
            turn[1:] = at[1:] != at[:-1] + 1
            begin = np.maximum.accumulate(np.where(turn, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            # what stands beside a merge when its turn comes: on the left perhaps the merge before
            left, right = row[np.maximum(at - 1, 0)], row[np.minimum(at + 2, len(row) - 1)]
            left[1:][at[1:] == at[:-1] + 2] = best
            merged = np.full(len(at), best, row.dtype)
            new = np.minimum(np.where(at > 0, self.rank(left, merged), NONE), np.where(at + 2 < len(row), self.rank(merged, right), NONE))
            lower = np.flatnonzero(new < best)
            at = at[: lower[0] + 1] if len(lower) else at
            row[at] = best
            row, ranks = np.delete(row, at + 1), np.delete(ranks, at)
            place = at - np.arange(len(at))
            open_ = np.concatenate([place - 1, place])
            open_ = open_[(open_ >= 0) & (open_ < len(ranks))]
            ranks[open_] = self.rank(row[open_], row[open_ + 1])
        return row

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and each word's number of ids."""
        pieces = [w.encode() for w in words]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        lengths, parts, order = np.zeros(len(pieces), np.int64), [], []
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        is_whole = np.flatnonzero(whole >= 0)
        lengths[is_whole] = 1
        parts.append(whole[is_whole].astype(np.uint32))
        order.append(is_whole)
        sizes[is_whole] = -1
        lo = 0
        for width in BUCKETS:
            for who in np.array_split(w := np.flatnonzero((sizes > lo) & (sizes <= width)), max(1, -(-len(w) * width // (ROWS * 16)))):
                if not len(who):
                    continue
                own = sizes[who]
                m = np.full((len(who), width), -1, np.int32)
                inside = np.arange(width) < own[:, None]
                m[inside] = self.single[np.frombuffer(b"".join([pieces[i] for i in who.tolist()]), np.uint8)]
                m, got = self.merge_matrix(m, own)
                lengths[who] = got
                parts.append(m[np.arange(width) < got[:, None]].astype(np.uint32))
                order.append(who)
            lo = width
        for i in np.flatnonzero(sizes > LONG).tolist():
            ids = self.merge_row(self.single[np.frombuffer(pieces[i], np.uint8)])
            lengths[i] = len(ids)
            parts.append(ids.astype(np.uint32))
            order.append(np.array([i]))
        # put the parts, which are in bucket order, back in word order
        order = np.concatenate(order) if order else np.empty(0, np.int64)
        flat = np.concatenate(parts)
        own = lengths[order]
        source = np.concatenate([[0], np.cumsum(own)])[:-1]
        place = np.empty(len(pieces), np.int64)
        place[order] = source
        before = np.concatenate([[0], np.cumsum(lengths)])
        where = np.repeat(place - before[:-1], lengths) + np.arange(before[-1])
        return flat[where], lengths

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def load(path: str) -> BpeTable:
    with open(path, "rb") as f:
        return BpeTable({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _cache(path: str) -> WordCache:
    """A cache for one task: kept with its worker, it would hold what the next stages need."""
    return WordCache(load(path).encode_words, WORDS)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = load(path), _cache(path)
        text_of = np.array([str(i) for i in range(max(table.bytes_of) + 1)], object)
        for batch in batches:
            n, shas, back, kept = [], [], [], []
            for _, ids in encode_texts(batch.column("text").to_pylist(), cache):
                n.append(len(ids))
                shas.append(hashlib.sha256(" ".join(text_of[ids]).encode()).hexdigest())
                back.append(hashlib.sha256(table.decode(ids.tolist())).hexdigest())
                if with_ids:
                    kept.append(ids.astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        for batch in batches:
            ids = [x.astype(np.int32) for _, x in encode_texts(batch.column("text").to_pylist(), cache)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, ids)`` of every row; a null or empty text has no ids. Repeated rows are encoded each."""
    return _texts(docs).mapInArrow(lean(_ids(ranks_path), "text", SLICE), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(ranks_path)
        for batch in batches:
            texts = [None if x is None else table.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: encoded and decoded again in one pass, without a shuffle.

    With ``with_ids`` the ids themselves follow.

    A null text counts as empty: no ids, and the digests of nothing. Null and repeated ids are
    ordinary rows; an empty table gives an empty table; other columns are not read.
    """
    return _texts(docs).mapInArrow(lean(_digests(ranks_path, with_ids), "text", SLICE), SCHEMA + ", ids array<int>" * with_ids)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
