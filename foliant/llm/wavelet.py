"""Token ids as one compressed wavelet-matrix file per shard.

A file holds the ids of consecutive documents as bit-planes: plane k has bit k (highest first) of every
id, in the order that the planes before have sorted the ids into, zeros first. Planes are zstd-compressed
in blocks of 65,536 bits; the directory has every block's offset and the number of ones before it, so
rank and select, and through them access, counting and occurrence lookup, decompress a few blocks only.

Layout: magic, header length (u32), JSON header, then the sections that the header names.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
import zlib
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.memory import lean
from foliant.llm.pretoken import WordCache, encode_texts
from foliant.runtime import fresh_path, materialize

MAGIC, BLOCK, END_ID, SHARD_TOKENS = b"WVMTRX1\n", 1 << 16, 2, 1 << 23


def build(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file of one shard. Null document ids are allowed."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    z = zstandard.ZstdCompressor(level=1)
    known = [0 if d is None else d for d in doc_ids]
    sections = [
        z.compress(np.array(known, np.int64).tobytes()),
        z.compress(np.packbits([d is None for d in doc_ids]).tobytes()),
        z.compress(np.array(lengths, np.uint64).tobytes()),
    ]
    zeros, order = [], ids
    for k in range(bits - 1, -1, -1):
        bit = (order & order.dtype.type(1 << k)) != 0
        ones, offsets, blocks, ordered = [0], [0], [], np.empty_like(order)
        n_zeros = len(ids) - int(np.count_nonzero(bit))
        # positions of a block at a time: masks over whole planes take about twice the time
        for at in range(0, len(order), BLOCK):
            own, part = order[at : at + BLOCK], bit[at : at + BLOCK]
            blocks.append(z.compress(np.packbits(part).tobytes()))
            zero, one = np.flatnonzero(~part), np.flatnonzero(part)
            to = at - ones[-1]
            ordered[to : to + len(zero)] = own[zero]
            to = n_zeros + ones[-1]
            ordered[to : to + len(one)] = own[one]
            ones.append(ones[-1] + len(one))
            offsets.append(offsets[-1] + len(blocks[-1]))
        sections += [np.array([ones, offsets], np.uint64).tobytes(), b"".join(blocks)]
        order = ordered
        zeros.append(len(ids) - ones[-1])
    head = json.dumps(
        {"n": len(ids), "bits": bits, "docs": len(doc_ids), "zeros": zeros, "sections": [len(s) for s in sections]}
    ).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


class WaveletFile:
    """Queries on one shard file."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack_from("<I", data, len(MAGIC))
        at = len(MAGIC) + 4
        self.head = json.loads(data[at : at + size])
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        at += size
        self._view, self._sections = memoryview(data), []
        for s in self.head["sections"]:
            self._sections.append((at, at + s))
            at += s
        self._z = zstandard.ZstdDecompressor()
        self._dir = [
            np.frombuffer(self._section(3 + 2 * k), np.uint64).astype(np.int64).reshape(2, -1) for k in range(self.bits)
        ]
        self._block = functools.lru_cache(256)(self._load)

    def _section(self, i: int) -> memoryview:
        return self._view[slice(*self._sections[i])]

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids and their numbers of tokens, in file order."""
        n = self.head["docs"]
        ids = np.frombuffer(self._z.decompress(self._section(0)), np.int64).tolist() if n else []
        null = np.unpackbits(np.frombuffer(self._z.decompress(self._section(1)), np.uint8))[:n] if n else []
        lengths = np.frombuffer(self._z.decompress(self._section(2)), np.uint64).astype(np.int64) if n else np.empty(0, np.int64)
        return [None if x else d for d, x in zip(ids, null)], lengths

    def _load(self, k: int, b: int) -> np.ndarray:
        offsets = self._dir[k][1]
        start = self._sections[4 + 2 * k][0]
        part = self._z.decompress(self._view[start + int(offsets[b]) : start + int(offsets[b + 1])])
        return np.unpackbits(np.frombuffer(part, np.uint8))

    def _rank1(self, k: int, i: int) -> int:
        b, rest = divmod(i, BLOCK)
        before = int(self._dir[k][0][min(b, len(self._dir[k][0]) - 1)])
        return before + (int(self._block(k, b)[:rest].sum()) if rest else 0)

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) ``bit`` of plane k."""
        ones = self._dir[k][0]
        have = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        b = int(np.searchsorted(have, j, "right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._block(k, b) == bit)[j - int(have[b])])

    def access(self, i: int) -> int:
        """The token at position i."""
        value = 0
        for k in range(self.bits):
            bit = int(self._block(k, i // BLOCK)[i % BLOCK])
            one = self._rank1(k, i)
            i = self.zeros[k] + one if bit else i - one
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in positions lo to hi (not included)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrence(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of a token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def all_ids(self) -> np.ndarray:
        """The whole sequence: the planes' sorting steps undone, last plane first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            up, ones = np.empty(self.n, kind), self._dir[k][0].tolist()
            for b in range(len(ones) - 1):
                at = b * BLOCK
                part = self._load(k, b)[: self.n - at].view(bool)
                own, zero, one = up[at : at + BLOCK], np.flatnonzero(~part), np.flatnonzero(part)
                since = at - ones[b]
                own[zero] = values[since : since + len(zero)]
                since = self.zeros[k] + ones[b]
                own[one] = values[since : since + len(one)] | kind(1 << (self.bits - 1 - k))
            values = up
        return values


def _byte_characters() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones themselves, others from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return dict(zip(rest, range(256, 512)))


_BYTES = _byte_characters()


@functools.cache
def _cache(path: str) -> tuple[WordCache, object, list[str]]:
    """Ids of pre-tokens, the tokenizer as its file sets it, and the added tokens, which it matches before it splits."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer, whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    model, pre = tokenizer.model, tokenizer.pre_tokenizer
    plain = tokenizer.normalizer is None and isinstance(pre, ByteLevel) and not pre.add_prefix_space

    def words(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if plain:  # pre-tokens are split already: the library's model takes them as they are
            found = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(_BYTES))] for w in new]
        else:
            found = [e.ids for e in tokenizer.encode_batch(new, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    return WordCache(words), whole, [t.content for t in whole.get_added_tokens_decoder().values()]


def _encoded(texts: list[str], tokenizer_path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(index of text, its token ids); a text that holds an added token goes to the tokenizer whole."""
    cache, whole, added = _cache(tokenizer_path)
    special = {i for i, t in enumerate(texts) if any(a in t for a in added)}
    for i, own in encode_texts(["" if i in special else t for i, t in enumerate(texts)], cache):
        yield i, np.array(whole.encode(texts[i], add_special_tokens=False).ids, np.uint32) if i in special else own


MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


def _writer(tokenizer_path: str, folder: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        docs, lengths, ids, size, seq = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            # a name of this attempt: what a lost or repeated attempt leaves is named by no manifest
            name = f"{base}/shard-{part:06d}-{seq:04d}-{attempt}.wvm"
            with fs.open_output_stream(name) as out:
                out.write(build(docs, lengths, np.concatenate(ids)))
            row = [[part], [seq], [f"{folder}/{os.path.basename(name)}"], [len(docs)], [size]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["part", "seq", "path", "n_docs", "n_tokens"])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, own in _encoded(batch.column("text").to_pylist(), tokenizer_path):
                docs.append(doc_ids[i])
                lengths.append(len(own) + 1)
                ids.append(np.append(own, own.dtype.type(END_ID)))
                size += len(own) + 1
                if size >= shard_tokens:
                    yield close()
                    docs, lengths, ids, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield close()

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write wavelet-matrix files in ascending doc_id order; returns their manifest, already written.

    The documents are range-partitioned by id once, as texts; each task encodes its range and closes a
    file after ``shard_tokens`` ids, at the end of a document. A null text counts as empty and gives the end id
    alone; null ids come first; equal ids are ordered by text. ``folder`` is a URI that pyarrow's file
    systems open, on storage that all executors share. An empty table gives no files.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32(F.encode("text", "UTF-8")))
    return materialize(ordered.mapInArrow(lean(_writer(tokenizer_path, folder, shard_tokens), "text"), MANIFEST), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as f:
                shard = WaveletFile(f.read())
            docs, lengths = shard.documents()
            ids = shard.all_ids().astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(base + starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files of a manifest.

    The running total needs one row per file, not per document, in one task.
    """
    files = manifest.count()
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    based = based.repartition(max(1, min(files, 20_000)))
    return based.mapInArrow(lean(_reader), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "wavelet"))
    return read_digests(manifest)
