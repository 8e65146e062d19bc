"""A bitmap of hashed keys, broadcast in pieces of fixed size, that keeps rows out of a join they cannot match.

Spark's own bloom filter joins ask for a creation side of a few megabytes; this one is bounded by its bits, not by
its keys. It only ever lets too much through: what passes still meets the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bits for a key, and the most bits (16 MB): beyond, more rows pass than match, and the join sees them
BITS_A_KEY, MAX_BITS, PIECE = 16, 27, 1024


def sift(rows: DataFrame, h: str, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` with a column ``maybe``: false where no key can have the row's hash ``h``.

    ``keys`` has the hashes of n keys, also named ``h``; null hashes on either side match nothing.
    """
    bits = min(MAX_BITS, max(16, (BITS_A_KEY * n - 1).bit_length()))
    low = lambda c: F.col(c).bitwiseAND((1 << bits) - 1)
    part = lambda c, by: F.call_function("shiftright", c, F.lit(by))
    own = keys.where("h is not null").select(
        part(low("h"), 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), low("h").bitwiseAND(63).cast("int")).alias("m")
    )
    all_ = keys.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("m"))
    words = own.union(all_).groupBy("word").agg(F.bit_or("m").alias("m"))
    pieces = words.groupBy(part(F.col("word"), 10).alias("sieve_piece")).agg(
        F.sort_array(F.collect_list(F.struct("word", "m"))).alias("l")
    ).select("sieve_piece", F.col("l.m").alias("sieve_words"))  # at most 2,048 rows of 1,024 numbers
    word = F.get("sieve_words", part(low(h), 6).bitwiseAND(PIECE - 1).cast("int"))
    maybe = F.coalesce(F.getbit(word, low(h).bitwiseAND(63).cast("int")) == 1, F.lit(False))
    out = rows.join(F.broadcast(pieces), part(low(h), 16) == F.col("sieve_piece"), "left")
    return out.withColumn("maybe", maybe).drop("sieve_piece", "sieve_words")


def without(docs: DataFrame, h: Column, gone: DataFrame, n: int, same) -> DataFrame:
    """``docs`` without the rows that match a row of ``gone``, all columns kept.

    ``h`` is a hash of a row of ``docs``; ``gone`` has n rows with the same hash in ``h``; ``same(row, gone)`` is the
    condition of a match, on equal hashes. Only rows whose hash passes the sieve are shuffled.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), h.alias("h"))
    rows = sift(rows, "h", gone.select("h"), n)
    hit, gone = rows.where("maybe").alias("r"), gone.alias("g")
    kept = hit.join(gone, (F.col("r.h") == F.col("g.h")) & same(F.col("r.row"), lambda c: F.col(f"g.{c}")), "left_anti").select("row")
    return rows.where("not maybe").select("row").union(kept).select("row.*")
