"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all token masses m_i = rate_i * size_i that meet every source's token target, entropy balancing
takes the one closest in Kullback-Leibler divergence to the masses there are. The dual is
g(l) = sum_s (S_s * exp(l_s) - l_s * T_s), so rate_i = exp(l_source(i)): the rates are exponentially
tilted. S_s, the sum over a source's documents, is the sufficient statistic of gradient and Hessian;
one distributed aggregation makes it and the Newton iterations then run as a fold over one row per
source, so the corpus is read once however many iterations there are.

Rates become copies by a hash of the row: floor(rate) or one more, where the hash lies below a cut. Cuts
are found by source and power-of-two class of size, longest class first, from the words of each of 4,096
hash bins: a class gets its share of what is left of the target, to within a bin, and what its bin leaves
over or short is spread over all shorter documents by their rate. The bin at one class's cut is then cut
inside, and the last few words are taken up by a few documents of each class, whose copies move by one.
Every step depends on row values alone, so reruns agree and a hot source is an ordinary sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.runtime import broadcast_if_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MAX_RATE, NEWTON_STEPS, PER_CLASS = (5, 2, 1), 3, 60, 6
HASH_BITS, BIN_BITS = 53, 12
BIN = 1 << (HASH_BITS - BIN_BITS)


def word_count(text: str = "text") -> Column:
    """Number of maximal runs without ASCII white space; null counts 0."""
    marked = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))
    return marked.cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``: weighted shares, water-filled.

    Sources in code-point order, null last, weigh ``weights`` in turn. A target stops at ``max_rate``
    times its source's size; the excess is shared anew by weight until none is above. Closed form: in
    ascending order of limit/weight the first k sources are full, for the least k at which the level
    (what is left / weight left) does not exceed the next limit/weight.
    The windows see one row per source, not per document.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ws = F.array(*map(F.lit, weights))
    w = sizes.withColumn("weight", F.element_at(ws, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    w = w.withColumn("limit", F.col("source_size") * F.lit(float(max_rate)))
    up = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    every, past = W.partitionBy(), up.rowsBetween(W.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(every).cast("double"))
    w = w.withColumn("all_weight", F.sum("weight").over(every))
    full, gone = F.coalesce(F.sum("limit").over(past), F.lit(0.0)), F.coalesce(F.sum("weight").over(past), F.lit(0.0))
    w = w.withColumn("level", (F.col("total") - full) / (F.col("all_weight") - gone))
    open_ = F.col("level") <= F.col("limit") / F.col("weight")
    up_place = F.row_number().over(W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source"))
    w = w.withColumn("open", open_).withColumn("place", up_place)
    w = w.withColumn("first_open", F.min(F.when(F.col("open"), F.col("place"))).over(every))
    w = w.withColumn("water", F.max(F.when(F.col("place") == F.col("first_open"), F.col("level"))).over(every))
    is_full = F.col("first_open").isNull() | (F.col("place") < F.col("first_open"))
    return w.select("source", "source_size", F.when(is_full, F.col("limit")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def newton_rates(table: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """Adds ``rate`` = exp(l) where Newton's iterations solve source_size * exp(l) = target from l = 0."""
    # one step: l - (S e^l - T) / (S e^l); upward steps are damped to 1
    size, target = F.col("source_size").cast("double"), F.col("target")
    step = lambda l, _: l + F.least(F.lit(1.0), target / (size * F.exp(l)) - 1)
    solved = F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step))
    return table.withColumn("rate", F.when((size > 0) & (target > 0), solved).otherwise(0.0))


def _hash(*cols: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << HASH_BITS))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, inside higher-order functions too."""
    return F.transform(F.array(value), use)[0]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: int = 9) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source, rate, copies.

    ``taken`` = copies * size, at most ``max_rate`` times the size. Each source's sum of taken comes near its target:
    cuts leave at most a bin's words over or short, the finer cut takes most of that up, and the last few documents
    of each class of size (PER_CLASS of them may move) the rest, down to half a small document. A source whose few
    documents are all long stays as far off as its shortest document is long. Null text has size 0 and is taken 0 times
    a size of 0; null sources form one source, the last. Rows that repeat id and size get equal copies.
    An empty table gives an empty table; a corpus without words has targets of 0. Other columns
    (``rate``, ``copies`` and so on included) are not read.
    """
    rows = _sized(docs)
    drawn = _drawn(rows, *_solve(rows, weights, max_rate, seed), max_rate, seed)
    return drawn.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies",
    )


def _sized(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "source", word_count().alias("size")), "sizes")


def _solve(rows: DataFrame, weights: tuple[int, ...], max_rate: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rates by source, cuts by source and class of size, and the documents whose copies move by one."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = materialize(newton_rates(targets(sizes, weights, max_rate)), "rates")
    cuts = materialize(_cuts(rows, rates, max_rate, seed), "cuts")
    rates = broadcast_if_small(rates.withColumnRenamed("source", "r_source"))
    cuts = broadcast_if_small(materialize(_finer(rows, cuts, max_rate, seed), "cuts"))
    moves = materialize(_corrections(_tilted(rows, rates, cuts, max_rate, seed), max_rate, seed), "moves")
    return rates, cuts, broadcast_if_small(moves)


def _classed(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with hash and class of size; rows without words have no class."""
    return rows.withColumn("hash", _hash("doc_id", "size", seed=seed)).withColumn(
        "class", F.when(F.col("size") > 0, F.floor(F.log2("size")).cast("int"))
    )


def _cuts(rows: DataFrame, rates: DataFrame, max_rate: int, seed: int) -> DataFrame:
    """(c_source, c_class, base, cut, gap): documents take ``base`` copies and, with a hash below ``cut``, one more.

    A bin at the border of a class's share is in or out by chance, unless the shorter documents could then not
    make up for it. ``gap`` is what the source's cuts leave of its target. At most 4,096 rows a class are listed.
    """
    bins = _classed(rows, seed).where("class is not null").groupBy(
        "source", "class", F.shiftright("hash", HASH_BITS - BIN_BITS).alias("bin")
    ).agg(F.sum("size").alias("words"))
    up = W.partitionBy("source", "class").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(up), F.lit(0)))
    classes = bins.groupBy("source", "class").agg(
        F.sum("words").alias("all"), F.sort_array(F.collect_list(F.struct("bin", "before", "words"))).alias("bins")
    ).withColumn("chance", _hash("source", "class", seed=seed) / float(1 << HASH_BITS))
    lists = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "all", "chance", "bins")), asc=False).alias("c"))
    both = rates.alias("r").join(lists.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")))
    start = F.struct(
        F.col("target").alias("left"), F.col("source_size").cast("double").alias("size"),
        F.array().cast("array<struct<c_class:int,base:bigint,cut:bigint>>").alias("cuts"),
    )
    most = float(max_rate)

    def step(s: Column, c: Column) -> Column:
        rate = F.greatest(F.lit(0.0), F.least(F.lit(most), s["left"] / s["size"]))

        def divide(rate: Column) -> Column:
            base = F.floor(rate)
            share = (rate - base) * c["all"]
            hit = F.filter(c["bins"], lambda b: (b["before"] <= share) & (share < b["before"] + b["words"]))
            last = F.struct(F.lit(1 << BIN_BITS).cast("bigint").alias("bin"), c["all"].alias("before"), F.lit(0).cast("bigint").alias("words"))
            return _let(F.coalesce(F.get(hit, F.lit(0)), last), lambda b: border(base, share, b))

        def border(base: Column, share: Column, b: Column) -> Column:
            out = s["left"] - base * c["all"] - b["before"]  # what is left of the target without the bin
            short = F.greatest(F.lit(0.0), out - most * (s["size"] - c["all"]))
            over = F.greatest(F.lit(0.0), b["words"] - out)
            draw = c["chance"] * b["words"] < share - b["before"]
            taken = (b["words"] > 0) & ((over < short) | ((over == short) & draw))
            return F.struct(
                (out - F.when(taken, b["words"]).otherwise(F.lit(0))).alias("left"), base.cast("bigint").alias("base"),
                ((b["bin"] + taken.cast("bigint")) * F.lit(BIN)).cast("bigint").alias("cut"),
            )

        return _let(_let(rate, divide), lambda d: F.struct(
            d["left"].alias("left"), (s["size"] - c["all"]).alias("size"),
            F.concat(s["cuts"], F.array(F.struct(c["class"].alias("c_class"), d["base"].alias("base"), d["cut"].alias("cut")))).alias("cuts"),
        ))

    done = both.select(F.col("r.source").alias("c_source"), F.aggregate("c", start, step).alias("s"))
    return done.select("c_source", F.col("s.left").alias("gap"), F.inline("s.cuts"))


def _finer(rows: DataFrame, cuts: DataFrame, max_rate: int, seed: int) -> DataFrame:
    """``cuts`` with one class's cut of each source moved inside its bin, as far as the source's gap goes."""
    near = _classed(rows, seed).where("class is not null").join(
        broadcast_if_small(cuts), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class"))
    )
    ahead = F.col("hash") - F.col("cut")
    up = (F.col("gap") > 0) & (ahead >= 0) & (ahead < BIN) & (F.col("base") < max_rate)
    down = (F.col("gap") < 0) & (ahead < 0) & (ahead >= -BIN)
    away = W.partitionBy("c_source", "c_class").orderBy("far").rangeBetween(W.unboundedPreceding, 0)
    near = near.where(up | down).withColumn("far", F.when(F.col("gap") > 0, ahead).otherwise(-ahead))
    near = near.withColumn("run", F.sum("size").over(away)).where(F.col("run") <= F.abs("gap"))
    best = near.groupBy("c_source", "c_class").agg(
        F.max("run").alias("run"), F.max(F.when(F.col("gap") > 0, F.col("hash") + 1)).alias("hi"), F.min("hash").alias("lo")
    ).groupBy(F.col("c_source").alias("b_source")).agg(
        F.max_by(F.struct(F.col("c_class").alias("class"), F.coalesce("hi", "lo").alias("cut")), F.struct("run", "c_class")).alias("b")
    )
    on = F.col("c_source").eqNullSafe(F.col("b_source")) & (F.col("c_class") == F.col("b.class"))
    return cuts.join(broadcast_if_small(best), on, "left").select("c_source", "c_class", "base", F.coalesce("b.cut", "cut").alias("cut"))


def _tilted(rows: DataFrame, rates: DataFrame, cuts: DataFrame, max_rate: int, seed: int) -> DataFrame:
    """``rows`` (doc_id, source, size) with source_size, target, rate and the copies that the hash draws."""
    out = _classed(rows.join(rates, F.col("source").eqNullSafe(F.col("r_source"))).drop("r_source"), seed)
    out = out.join(cuts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")), "left")
    base = F.coalesce("base", F.floor("rate"))  # rows without words are drawn by the rate itself
    cut = F.coalesce(F.col("cut").cast("double"), (F.col("rate") - F.floor("rate")) * float(1 << HASH_BITS))
    copies = F.least(base + (F.col("hash") < cut).cast("long"), F.lit(max_rate)).cast("long")
    return out.withColumn("copies", copies).drop("hash", "class", "c_source", "c_class", "base", "cut")


def _drawn(rows: DataFrame, rates: DataFrame, cuts: DataFrame, moves: DataFrame, max_rate: int, seed: int) -> DataFrame:
    on = F.col("source").eqNullSafe(F.col("m_source")) & F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("size") == F.col("m_size"))
    out = _tilted(rows, rates, cuts, max_rate, seed).join(moves, on, "left").drop("m_source", "m_id", "m_size")
    return out.withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move")


def _corrections(drawn: DataFrame, max_rate: int, seed: int) -> DataFrame:
    """(m_source, m_id, m_size, move): copies to add or drop so that a source meets its target.

    Up to PER_CLASS documents of each source, direction and power-of-two class of size are candidates; in
    descending size each is moved if that brings the sum nearer to the target. The cuts have left little to move.
    """
    gap = drawn.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"), F.first("rate").alias("rate")
    )
    able = drawn.where("size > 0 and rate > 0").select("source", "doc_id", "size", "copies").withColumn(
        "move",
        F.explode(F.array_compact(F.array(F.when(F.col("copies") < max_rate, F.lit(1)), F.when(F.col("copies") > 0, F.lit(-1))))),
    )
    picks = W.partitionBy("source", "class", "move").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size")
    able = able.withColumn("class", F.floor(F.log2("size"))).withColumn("nth", F.row_number().over(picks)).where(f"nth <= {PER_CLASS}")
    one = able.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"), F.min("move").alias("move"), F.max("move").alias("up"))
    # a document that could move both ways is a candidate for either; repeated rows would move together
    one = one.where((F.col("n") == 1) | ((F.col("n") == 2) & (F.col("move") != F.col("up"))))
    lists = one.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("size", "doc_id", F.col("move").alias("down"), "up")), asc=False).alias("c")
    )
    start = F.struct(F.col("gap"), F.array().cast("array<struct<m_id:bigint,m_size:bigint,move:int>>").alias("moves"))

    def pick(s: Column, c: Column) -> Column:
        up = (s["gap"] > 0) & (c["up"] == 1) & (F.abs(s["gap"] - c["size"]) < F.abs(s["gap"]))
        down = (s["gap"] < 0) & (c["down"] == -1) & (F.abs(s["gap"] + c["size"]) < F.abs(s["gap"]))
        way = F.when(up, F.lit(1)).when(down, F.lit(-1)).otherwise(F.lit(0))
        item = F.struct(c["doc_id"].cast("bigint").alias("m_id"), c["size"].alias("m_size"), way.alias("move"))
        return F.struct((s["gap"] - way * c["size"]).alias("gap"), F.when(way != 0, F.concat(s["moves"], F.array(item))).otherwise(s["moves"]).alias("moves"))

    both = gap.alias("g").join(lists.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")))
    folded = both.select(F.col("g.source").alias("m_source"), F.aggregate("c", start, pick)["moves"].alias("moves"))
    return folded.select("m_source", F.inline("moves"))


def take_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: int = 9) -> DataFrame:
    """``docs`` mixed: every row repeated as often as :func:`mix` takes it, same columns, same ids.

    Texts are not shuffled: rates and corrections come to the rows.
    """
    solved = _solve(_sized(docs), weights, max_rate, seed)
    rows = docs.select("doc_id", "source", word_count().alias("size"), F.struct(*docs.columns).alias("row"))
    taken = _drawn(rows, *solved, max_rate, seed)
    taken = taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("nth"))
    return taken.select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
