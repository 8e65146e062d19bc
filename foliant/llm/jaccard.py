"""N-gram Jaccard join by set-relation skipping.

A document is the set of its word shingles (64-bit hashes). Equal sets are one class, and a class is one
entry of every index list. Sets are ordered rare shingles first, and only the first ``n - ceil(t n) + 1``
members of a set of n enter the index: two linked sets share one of them.

* Answers first: every list compares its sets with one leader, by texts. The symmetric difference of sets
  is a metric, so a leader's answers hold bounds for its members: sets at distances d1 and d2 from a leader
  are at least |d1 - d2| and at most d1 + d2 apart. Sets linked with a leader share a label; what shares a
  label is connected and needs no answer any more, so a group of k near copies costs about k comparisons
  instead of k * k / 2.
* Blocks next: the entries of a list are blocked by (size, leader) and sorted by position inside a block. For
  a pair of blocks, sizes give the overlap that links need, hence the last position from which it can still
  be reached, in either block; entries behind it are skipped as a whole, by one search. A pair of blocks of
  one label, or of one leader whose distances lie too far apart, is skipped before any pair of it exists.
* The pairs that are left meet the bounds of their common leader, then the parities of their members in 512
  hashed cells: two sets differ in at least as many members as their parities differ. Texts decide the rest.

The order needs a global frequency, but any order is correct: document counts are kept in hashed cells, about
one for CELL_LOAD shingles of the corpus. A list of more than BLOCK_ROWS entries is answered by units: pairs
of blocks of that many entries, except those within the label that holds most of the list.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.graph import connected_components
from foliant.llm.memory import lean, release_driver
from foliant.llm.sieve import sift, without
from foliant.llm.spans import mix, span_hashes
from foliant.runtime import Scratch, materialize

SHINGLE_WORDS, PERCENT, SLICE, LEADER_ROUNDS, SPAN = 3, 90, 1 << 14, 3, 1 << 19
#: shingles of the corpus to a frequency cell; cells are a power of two within these bounds (8 bytes each)
CELL_LOAD, MIN_CELL_BITS, MAX_CELL_BITS = 64, 16, 22
PARITIES = 512
#: entries of a list that one task compares with each other; members that are compared with one copy of a leader
BLOCK_ROWS, MEMBERS = 4096, 64
#: pairs that the blocks of a list give out at a time
PAIRS = 1 << 18
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts between ``offsets``, and the number of words before each offset."""
    low = _LOWER[flat]
    word = ~_SPACE[flat]
    before = np.zeros(len(flat), bool)
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(flat)]] = False
    after = np.zeros(len(flat), bool)
    after[:-1] = word[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    (h,) = span_hashes(low, starts, stops, two=False)
    return h, np.searchsorted(starts, offsets)


def _long_words(flat: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, in spans that end at white space."""
    found, at = [], 0
    while at < len(flat):
        end = min(at + SPAN, len(flat))
        while end < len(flat) and not (cut := np.flatnonzero(_SPACE[flat[end : end + SPAN]])).size:
            end = min(end + SPAN, len(flat))  # a word of more than SPAN bytes stays whole
        end = end + int(cut[0]) if end < len(flat) else end
        found.append(_words(flat[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(found)


def _sets(h: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    n = len(h)
    grams = np.zeros(max(0, n - k + 1), _U)
    for i in range(k):
        grams = mix(grams + h[i : i + len(grams)] * _U(0x9FB21C651E98DF25) + _U(i + 1))
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], _U)
            for x in h[a:b]:
                whole = mix(whole * _U(0xC2B2AE3D27D4EB4F) + x)
            sets.append(whole)
        else:
            sets.append(np.empty(0, _U))
    return sets


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: k words, or all words where there are fewer.

    Memory grows with SPAN and, for a text of more than that, with 16 bytes a word.
    """
    texts = texts.cast(pa.large_binary())
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SPAN, "right")) - 1)
        part = flat[offsets[i] : offsets[j]]
        if len(part) > SPAN:  # then it is one text
            h = _long_words(part)
            yield from _sets(h, np.array([0, len(h)]), k)
        else:
            yield from _sets(*_words(part, offsets[i : j + 1] - offsets[i]), k)
        i = j


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of linked sets of n and m members."""
    up = (n + m).cast("long") * percent + (99 + percent)
    return ((up - up % (100 + percent)) / (100 + percent)).cast("long")


def needed(n, m, percent: int):
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _prints(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set."""
    return int(mix(s).sum(dtype=_U)), int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))


PROFILE = "doc_id long, n long, fp1 long, fp2 long, bits array<long>, slice int, cells binary, print long"


def _packed(counts: np.ndarray) -> bytes:
    """One slice of a task's cells: a byte a cell, then places and counts of those that need more, all compressed.

    A task's counts are small, so a slice takes a few bits a cell: with plain numbers the cells of all tasks, whose
    number grows with the corpus as the cells do, would outgrow the corpus.
    """
    more = np.flatnonzero(counts > 255)
    run_lengths = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL, zlib.Z_RLE)
    plain = np.minimum(counts, 255).astype(np.uint8).tobytes() + np.concatenate([more, counts[more]]).astype(np.int32).tobytes()
    return run_lengths.compress(plain) + run_lengths.flush()


def _unpacked(packed: bytes) -> np.ndarray:
    plain = zlib.decompress(packed)
    counts = np.frombuffer(plain, np.uint8, SLICE).astype(np.int64)
    more, full = np.frombuffer(plain, np.int32, offset=SLICE).reshape(2, -1)
    counts[more] = full
    return counts


def _profile(k: int, cell_bits: int):
    """Per document (doc_id, n, fp1, fp2, bits, print); per task, the number of documents in each cell, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << cell_bits, np.int32)
        names = ["doc_id", "n", "fp1", "fp2", "bits", "slice", "cells", "print"]
        any_ = False
        for batch in batches:
            n, prints, bits = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                any_ = any_ or len(s) > 0
                np.add.at(cells, (s >> _U(64 - cell_bits)).astype(np.int64), 1)
                n.append(len(s))
                prints.append(_prints(s))
                odd = np.bincount((s & _U(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
                bits.append(np.packbits(odd.astype(bool)).view(np.int64))
            empty = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), *(_signed(np.array([p[i] for p in prints], _U)) for i in (0, 1)),
                    pa.array(bits, pa.list_(pa.int64())), pa.array(empty, pa.int32()), pa.array(empty, pa.binary()), batch.column("print"),
                ],
                names,
            )
        if any_:
            for i in range(0, len(cells) // SLICE, 64):
                rows = [(j, _packed(cells[j * SLICE : (j + 1) * SLICE])) for j in range(i, min(i + 64, len(cells) // SLICE))]
                none = pa.array([None] * len(rows), pa.int64())
                bare = pa.array([None] * len(rows), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, none, bare, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), none], names
                )

    return run


def _add_slices(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLICE, np.int64)
    for c in pdf["cells"]:
        total += _unpacked(c)
    return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "cells": [total.tobytes()]})


def _postings(k: int, percent: int, cells, cell_bits: int):
    """Prefix members of each distinct set of a batch: token, n, pos, fp1, fp2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = cells.value
        for batch in batches:
            prefixes: dict[tuple[int, int, int], np.ndarray] = {}
            for s in shingle_sets(batch.column("text"), k):
                n = len(s)
                if not n:
                    continue
                key = (*_prints(s), n)
                if key not in prefixes:
                    order = np.lexsort((s, count[(s >> _U(64 - cell_bits)).astype(np.int64)]))[: prefix_length(n, percent)]
                    prefixes[key] = s[order]
            if not prefixes:
                continue
            sizes = np.array([len(p) for p in prefixes.values()])
            ends = np.cumsum(sizes)
            pos = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            of = [np.repeat(np.array(x, _U), sizes) for x in zip(*prefixes)]
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate(list(prefixes.values()))), pa.array(of[2].astype(np.int32)), pa.array(pos.astype(np.int32)), _signed(of[0]), _signed(of[1])],
                ["token", "n", "pos", "fp1", "fp2"],
            )

    return run


LIST = ["token", "n", "pos", "fp1", "fp2"]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by (token, n, fp1, fp2): equal sets once, lists of one set not at all."""
    held: pa.RecordBatch | None = None  # the last distinct entry, whose list may go on
    held_shared = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token, n, fp1, fp2 = (batch.column(c).to_numpy() for c in ("token", "n", "fp1", "fp2"))
        new_list = np.ones(len(token), bool)
        new_list[1:] = token[1:] != token[:-1]
        distinct = new_list.copy()
        distinct[1:] |= (n[1:] != n[:-1]) | (fp1[1:] != fp1[:-1]) | (fp2[1:] != fp2[:-1])
        keep = np.flatnonzero(distinct)
        starts = new_list[keep]
        ends = np.append(starts[1:], True)
        shared = ~(starts & ends)
        if held is not None and not starts[1:2].any() and len(keep) > 1:
            shared[0] = True
        if held_shared:
            shared[0] = True
        out = keep[:-1][shared[:-1]]
        if len(out):
            yield batch.take(pa.array(out)).select(LIST)
        held_shared = bool(shared[-1])
        held = batch.slice(int(keep[-1]), 1)
    if held is not None and held_shared:
        yield held.select(LIST)


def _cross(percent: int):
    """Pairs of different labels of each list, from entries sorted by (token, unit, n, leader, pos).

    ``linked`` is true where the common leader's answers already tell that a pair is linked.
    """

    def pairs(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        token, unit, ids, n, pos, comp, leader, dist, side = (
            part.column(c).to_numpy() for c in ("token", "unit", "id", "n", "pos", "comp", "leader", "dist", "side")
        )
        bits = part.column("bits").flatten().to_numpy().reshape(len(token), -1)
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        opens = np.ones(len(token), bool)
        opens[1:] = (token[1:] != token[:-1]) | (unit[1:] != unit[:-1])
        block = opens.copy()
        block[1:] |= (n[1:] != n[:-1]) | (leader[1:] != leader[:-1])
        first = np.flatnonzero(block)
        own_list, size, led = np.cumsum(opens)[first], n[first], leader[first]
        near, far = np.minimum.reduceat(dist, first), np.maximum.reduceat(dist, first)
        lo, hi = np.minimum.reduceat(comp, first), np.maximum.reduceat(comp, first)
        stride = int(pos.max()) + 2
        places = (np.cumsum(block) - 1) * stride + pos  # ascending: blocks, then positions

        def reach(at: np.ndarray, least: np.ndarray) -> np.ndarray:
            """How many of a block's entries come before the overlap is out of reach."""
            return np.searchsorted(places, at * stride + np.minimum(size[at] - least, stride - 1), "right") - first[at]

        live, d = np.arange(len(first)), 0
        while len(live):
            live = live[live + d < len(first)]
            live = live[(own_list[live + d] == own_list[live]) & (percent * size[live + d] <= 100 * size[live])]
            other = live + d
            least = needed(size[live], size[other], percent)
            apart = size[live] + size[other] - 2 * least
            one = (lo[live] == hi[live]) & (lo[other] == hi[other]) & (lo[live] == lo[other])
            gap = np.maximum(near[other] - far[live], near[live] - far[other])
            skip = one | ((led[live] == led[other]) & (led[live] >= 0) & (gap > apart))
            i, j, least, apart = (x[~skip] for x in (live, other, least, apart))
            wide, high = reach(i, least), reach(j, least)
            ends = np.cumsum(wide * high)
            for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                k = np.arange(at, min(at + PAIRS, int(ends[-1])))
                r = np.searchsorted(ends, k, "right")
                k -= ends[r] - wide[r] * high[r]
                a, b = first[i[r]] + k // high[r], first[j[r]] + k % high[r]
                good = (comp[a] != comp[b]) & ((side[a] < 0) | (side[a] != side[b]))
                if d == 0:
                    good &= a < b
                a, b, most = a[good], b[good], apart[r[good]]
                same = (leader[a] == leader[b]) & (leader[a] >= 0)
                linked = same & (dist[a] + dist[b] <= most)
                good = ~(same & (np.abs(dist[a] - dist[b]) > most))
                a, b, most, linked = a[good], b[good], most[good], linked[good]
                good = linked | (np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= most)
                a, b, linked = a[good], b[good], linked[good]
                turned = ids[a] > ids[b]
                a, b = np.where(turned, b, a), np.where(turned, a, b)
                if len(a):
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ids[a], ids[b], n[a], n[b], linked))], ["a", "b", "na", "nb", "linked"])
            d += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        key = lambda batch, i: tuple(batch.column(c)[i].as_py() for c in ("token", "unit"))
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            last = key(batch, batch.num_rows - 1)
            if key(rest[0], 0) == last:
                continue
            table = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            token, unit = table.column("token").to_numpy(), table.column("unit").to_numpy()
            cut = int(np.flatnonzero((token != last[0]) | (unit != last[1]))[-1]) + 1
            yield from pairs(table.slice(0, cut))
            rest = [table.slice(cut)]
        if rest:
            yield from pairs(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])

    return run


def _verify(k: int):
    """Exact overlaps from rows sorted by (a, salt, kind, cid): a leader's text (kind 0), then its members' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, last = None, None, None
        for batch in batches:
            a, salt, kind, cid = (batch.column(c).to_pylist() for c in ("a", "salt", "kind", "cid"))
            want = list(zip(batch.column("fp1").to_numpy().view(np.uint64).tolist(), batch.column("fp2").to_numpy().view(np.uint64).tolist()))
            out: list[tuple] = []
            for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                if _prints(s) != want[i]:
                    continue  # another text of a repeated id
                if kind[i] == 0:
                    at, left, last = (a[i], salt[i]), s, None
                elif at == (a[i], salt[i]) and cid[i] != last:
                    last = cid[i]
                    place = np.minimum(np.searchsorted(left, s), len(left) - 1)
                    out.append((a[i], last, len(left), len(s), int((left[place] == s).sum())))
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b", "na", "nb", "overlap"])

    return run


def _compare(scratch: Scratch, pairs: DataFrame, n: int, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, na, nb, overlap, linked) of n pairs of classes; written to the shared folder.

    Only texts that occur in a pair move (others stop at a sieve before the shuffle): a member's once for each
    of its leaders, a leader's once for every MEMBERS members. The texts of an id that repeats all come along; fingerprints tell which one is meant.
    """
    need = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "rep_id", "fp1", "fp2"), "cid")
    rows = sift(docs.withColumn("h", F.xxhash64("doc_id")), "h", need.select(F.xxhash64("rep_id").alias("h")), 2 * n)
    rows = rows.where("maybe").select("doc_id", "text")
    texts = scratch.keep(rows.join(need, rows.doc_id == F.col("rep_id")).select("cid", "fp1", "fp2", "text"), "texts")
    many = pairs.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > MEMBERS)
    parts = F.coalesce(F.ceil(F.col("m") / MEMBERS), F.lit(1)).cast("long")
    dealt = pairs.select("a", "b").join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("salt"))
    columns = ["a", "salt", "kind", "cid", "fp1", "fp2", "text"]
    members = dealt.withColumnRenamed("b", "cid").join(texts, "cid").withColumn("kind", F.lit(1)).select(*columns)
    leaders = dealt.select("a", "salt").distinct().join(texts, F.col("a") == F.col("cid")).withColumn("kind", F.lit(0)).select(*columns)
    rows = leaders.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "cid")
    out = rows.mapInArrow(lean(_verify(k), "text"), "a long, b long, na long, nb long, overlap long")
    out = scratch.keep(out.withColumn("linked", F.col("overlap") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent), "compared")
    scratch.drop(texts)
    return out


def _states(scratch: Scratch, compared: DataFrame) -> DataFrame:
    """(id, comp, leader, dist) of all compared classes.

    ``comp`` labels the component of what is linked so far. ``leader`` is the nearest class that they were compared
    with as a leader, ``dist`` the number of members in which the two differ.
    """
    apart = F.col("na") + F.col("nb") - 2 * F.col("overlap")
    ends = F.array(
        F.struct(F.col("b").alias("id"), F.struct(apart.alias("dist"), F.col("a").alias("leader")).alias("best")),
        F.struct(F.col("a").alias("id"), F.struct(F.lit(0).cast("long").alias("dist"), F.col("a").alias("leader")).alias("best")),
    )
    best = compared.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.min("e.best").alias("best"))
    parts = connected_components(compared.where("linked"), "a", "b", scratch)
    state = best.join(parts, F.col("id") == F.col("node"), "left")
    return scratch.keep(state.select("id", F.coalesce("component_id", "id").alias("comp"), "best.leader", "best.dist"), "states")


def _placed(lists: DataFrame, states: DataFrame | None) -> DataFrame:
    """List entries with label, leader and distance; a class that was not compared is its own label."""
    if states is None:
        return lists.withColumns({"comp": F.col("id"), "leader": F.lit(-1).cast("long"), "dist": F.lit(0).cast("long")})
    return lists.join(states, "id", "left").withColumns({
        "comp": F.coalesce("comp", "id"), "leader": F.coalesce("leader", F.lit(-1)), "dist": F.coalesce("dist", F.lit(0)),
    })


def _enough(percent: int) -> Column:
    """Pairs whose number of shared prefix members does not rule out a link."""
    rest = F.greatest(*(F.col(x) - (F.col(x) - F.floor((F.col(x) * percent + 99) / 100) + 1) for x in ("na", "nb")))
    return F.col("shared") >= _needed(F.col("na"), F.col("nb"), percent) - rest


def _leader_pairs(placed: DataFrame, bits: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each list's sets of other labels than the leader's, against one leader of the list.

    The first leader is the set in which the token comes first: it has the fewest rare members, as the text
    has that others were made from. Later leaders are drawn by a hash, mostly from the largest label, so that what
    has stayed apart from it is compared with ever other members of it, and labels meet.
    """
    key = F.struct("pos" if turn == 0 else F.lit(0), F.xxhash64("id", F.lit(turn)))
    lead = placed.groupBy("token").agg(F.min_by(F.struct("id", "n", "comp"), key).alias("l"))
    fits = (F.col("n") * percent <= F.col("l.n") * 100) & (F.col("l.n") * percent <= F.col("n") * 100)
    pairs = placed.join(lead, "token").where((F.col("comp") != F.col("l.comp")) & fits)
    pairs = pairs.select(F.col("l.id").alias("a"), F.col("id").alias("b"), F.col("l.n").alias("na"), F.col("n").alias("nb"))
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(_enough(percent))
    pairs = pairs.join(bits.select(F.col("cid").alias("a"), F.col("bits").alias("bits_a")), "a")
    pairs = pairs.join(bits.select(F.col("cid").alias("b"), F.col("bits").alias("bits_b")), "b")
    differ = F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(differ, F.lit(0), lambda s, x: s + x)
    return pairs.where(apart <= F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb")


def _cross_pairs(placed: DataFrame, bits: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """(a, b, na, nb, linked) of sets of different labels that share a list and that no bound tells apart.

    A list of up to ``block_rows`` entries is one unit. Of a longer one, the entries of its main label and the
    others are dealt to blocks of about that many; units are pairs of blocks, except those of two main blocks.
    """
    by_label = placed.groupBy("token", "comp").agg(F.count("*").alias("c"))
    stats = by_label.groupBy("token").agg(
        F.sum("c").alias("total"), F.max("c").alias("main_n"), F.max_by("comp", "c").alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    ).where("lo <> hi")
    rows = placed.join(stats.drop("lo", "hi"), "token").join(bits.select(F.col("cid").alias("id"), "bits"), "id")
    blocks = lambda n: F.ceil(n / F.lit(float(block_rows))).cast("long")
    rows = rows.withColumns({"k1": blocks(F.col("main_n")), "k2": blocks(F.col("total") - F.col("main_n")), "in_main": F.col("comp") == F.col("main")})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("k1")).otherwise(F.col("k2"))))
    own, k1, k2 = F.col("own"), F.col("k1"), F.col("k2")
    zero = F.lit(0).cast("long")
    unit = lambda u, side: F.struct(u.alias("unit"), side.cast("int").alias("side"))
    mains = F.transform(F.sequence(zero, k2 - 1), lambda j: unit(k2 * k2 + own * k2 + j, F.lit(0)))
    others = F.transform(F.sequence(zero, k2 - 1), lambda t: unit(
        F.least(own, t) * k2 + F.greatest(own, t), F.when(t == own, F.lit(-1)).when(own < t, F.lit(0)).otherwise(F.lit(1))
    ))
    across = F.transform(F.sequence(zero, k1 - 1), lambda i: unit(k2 * k2 + i * k2 + own, F.lit(1)))
    units = F.when(F.col("total") <= block_rows, F.array(unit(zero, F.lit(-1)))).when(F.col("in_main"), mains).otherwise(F.concat(others, across))
    rows = rows.select("token", F.inline(units), "id", "n", "pos", "comp", "leader", "dist", "bits")
    rows = rows.repartition("token", "unit").sortWithinPartitions("token", "unit", "n", "leader", "pos")
    found = rows.mapInArrow(lean(_cross(percent)), "a long, b long, na long, nb long, linked boolean")
    return found.groupBy("a", "b", "na", "nb").agg(F.max("linked").alias("linked"))


def _cells(slices: DataFrame, cell_bits: int) -> np.ndarray:
    cells = np.zeros(1 << cell_bits, np.int32)
    added = slices.groupBy("slice").applyInPandas(_add_slices, "slice int, cells binary")
    for row in added.toLocalIterator():  # a table of fixed size, one slice after the other
        total = np.frombuffer(row["cells"], np.int64)
        cells[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.minimum(total, 2**31 - 1)
    return cells


def _answers(docs: DataFrame, k: int, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, print (hash of the text), n, component_id, keeps.

    ``keeps`` is true for the rows of one class of each component that have its smallest id, for rows without
    id and for rows without words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cell_bits = min(MAX_CELL_BITS, max(MIN_CELL_BITS, int(size // (6 * CELL_LOAD)).bit_length()))  # some six bytes a word
    both = materialize(
        docs.withColumn("print", F.xxhash64("text")).mapInArrow(lean(_profile(k, cell_bits), "text"), PROFILE), "profiles"
    )
    profiles = both.where("slice is null").select("doc_id", "print", "n", "fp1", "fp2", "bits")
    classes = profiles.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep_id"), F.first("bits").alias("bits"))
    # the numbers hold because the table is written before it is read
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    order = spark.sparkContext.broadcast(_cells(both.where("slice is not null").select("slice", "cells"), cell_bits))
    postings = known.mapInArrow(lean(_postings(k, percent, order, cell_bits), "text"), "token long, n int, pos int, fp1 long, fp2 long")
    by_token = postings.repartition("token").sortWithinPartitions("token", "n", "fp1", "fp2")
    lists = by_token.mapInArrow(lean(_lists), "token long, n int, pos int, fp1 long, fp2 long")
    lists = lists.withColumn("n", F.col("n").cast("long")).join(classes.select("fp1", "fp2", "n", F.col("cid").alias("id")), ["fp1", "fp2", "n"])
    lists = scratch.keep(lists.select("token", "id", F.col("n").cast("int").alias("n"), "pos"), "lists")
    order.unpersist()
    release_driver(spark)

    compared, states = None, None
    for turn in range(LEADER_ROUNDS):
        pairs = _leader_pairs(_placed(lists, states), classes, turn, percent)
        if compared is not None:
            pairs = pairs.join(compared.select("a", "b").union(compared.select("b", "a")), ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, "leaders")
        n = pairs.count()
        if not n:
            break
        answers = _compare(scratch, pairs, n, known, classes, k, percent)
        compared = answers if compared is None else compared.unionByName(answers)
        states = _states(scratch, compared)
        release_driver(spark)

    left = _cross_pairs(_placed(lists, states), classes, percent, block_rows)
    links = []
    if compared is not None:
        links.append(compared.where("linked").select("a", "b"))
        done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = left.join(done, ["a", "b"], "left_anti")
    left = scratch.keep(left, "rest")
    release_driver(spark)
    links.append(left.where("linked").select("a", "b"))
    open_ = left.where("not linked").select("a", "b")
    if n := open_.count():
        links.append(_compare(scratch, open_, n, known, classes, k, percent).where("linked").select("a", "b"))
    every = links[0]
    for x in links[1:]:
        every = every.union(x)
    parts = connected_components(every, "a", "b", scratch)

    named = classes.select("fp1", "fp2", "n", "rep_id", "cid").join(parts, F.col("cid") == F.col("node"), "left")
    named = scratch.keep(named.select("fp1", "fp2", "n", "rep_id", "cid", F.coalesce("component_id", "cid").alias("comp")), "named")
    least = named.groupBy("comp").agg(F.min(F.struct("rep_id", "cid")).alias("m")).select("comp", F.col("m.rep_id").alias("least"), F.col("m.cid").alias("keeper"))
    least = scratch.keep(least, "least")
    named = named.join(least, "comp").select("fp1", "fp2", "n", "least", (F.col("cid") == F.col("keeper")).alias("first"))
    named = materialize(named, "answers")
    scratch.drop()
    release_driver(spark)
    found = profiles.drop("bits").join(named, ["fp1", "fp2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    keeps = F.coalesce(F.col("first") & (F.col("doc_id") == F.col("least")), F.col("least").isNull() | F.col("doc_id").isNull())
    return found.select("doc_id", "print", "n", own.alias("component_id"), keeps.alias("keeps"))


def similarity_components(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A-Z become lower case; words are runs without ASCII white space. Two documents link when
    100 * overlap >= percent * union of their sets; ``component_id`` is the smallest doc_id reachable.
    Documents without words (null and empty texts among them) link with nothing. Rows without id are
    answered with null component and link with nothing; rows that repeat an id are documents of their
    own, so their components differ where their texts do. An empty table gives an empty table. Other
    columns are not read.
    """
    return _answers(docs, k, percent, block_rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns kept.

    Rows without id or without words stay. Of rows that share the smallest id, those of one set of shingles
    stay; rows that repeat both id and text share their verdict. Only texts that a sieve cannot clear are shuffled.
    """
    gone = _answers(docs, k, percent).where("not keeps").select(F.col("doc_id").alias("g_id"), "print").distinct()
    gone = materialize(gone.withColumn("h", F.xxhash64("g_id", "print")), "gone")
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    same = lambda r, g: (r["doc_id"] == g("g_id")) & (F.xxhash64(F.coalesce(r["text"], F.lit(""))) == g("print"))
    return without(docs, F.xxhash64(F.col("doc_id").cast("long"), own), gone, gone.count(), same)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
