"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A document's features are its words, its pairs of adjacent words and the character 3- and 4-grams of its
words (with a blank on either side), hashed into BUCKETS rows of a vector table. The document's vector is
the mean of its features' vectors; a softmax over a linear layer gives the score. Table and layer are
learned together. For scoring, a feature's vector matters only through its product with the layer, so the
table shrinks to one number per bucket, and a word's features to one sum that is kept between batches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.memory import lean, release
from foliant.llm.spans import SpanIndex, mix, span_hashes

BUCKETS, DIM, GRAMS, EPOCHS, BATCH, RATE, SEED = 1 << 17, 12, (3, 4), 4, 32, 20.0, 3
#: the classifier is fitted on at most so many documents with so many distinct features together
TRAIN_DOCS, TRAIN_FEATURES = 4_000, 20_000_000
THRESHOLD, FOLDS = 0.3, 5
_CACHED_WORDS = 400_000


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points with every white space a blank and one blank around each text; word starts and ends;
    and the number of words before each text (and after the last)."""
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points >= 9) & (points <= 13)] = 0x20
    blank = points == 0x20
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return points, starts, ends, np.searchsorted(starts, edges, "right")


def _grams(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the character n-grams of words that are padded by a blank, and whose they are."""
    a, b, who = [], [], []
    for n in GRAMS:
        count = np.maximum(ends - starts + 3 - n, 0)
        word = np.repeat(np.arange(len(starts)), count)
        at = starts[word] - 1 + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        a.append(at)
        b.append(at + n)
        who.append(word)
    return np.concatenate(a), np.concatenate(b), np.concatenate(who)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def _pairs(k1: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of pairs of adjacent words of one text, and the place of each pair's first word."""
    first = np.ones(len(k1) + 1, bool)
    first[:-1] = False
    first[at] = True
    here = np.flatnonzero(~first[1:-1]) if len(k1) > 1 else np.empty(0, np.int64)
    return mix(k1[here] * np.uint64(0x9FB21C651E98DF25) + k1[here + 1]), here


def featurize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and how often each occurs."""
    points, starts, ends, at = _flat([text])
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    (k1,) = span_hashes(points, starts, ends, two=False)
    ga, gb, _ = _grams(starts, ends)
    (g,) = span_hashes(points, ga, gb, two=False)
    pairs, _ = _pairs(k1, at)
    return np.unique(_bucket(np.concatenate([k1, g, pairs])), return_counts=True)


class Model:
    """One number per bucket and a bias: the log-odds of label 1 is their mean over a text, plus the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scorer(self):
        """A function from texts to scores that keeps what it learns about words between calls."""
        index, sums, counts = SpanIndex(), np.empty(0), np.empty(0)

        def part(texts: list[str]) -> np.ndarray:
            nonlocal index, sums, counts
            points, starts, ends, at = _flat(texts)
            logit = np.zeros(len(texts))
            if len(starts):
                if index.n > _CACHED_WORDS:
                    index, sums, counts = SpanIndex(), np.empty(0), np.empty(0)
                k1, k2 = span_hashes(points, starts, ends)
                code = index.find(k1, k2)
                lost = np.flatnonzero(code < 0)
                if len(lost):
                    _, one, back = np.unique(k1[lost] ^ (k2[lost] << np.uint64(1)), return_index=True, return_inverse=True)
                    one = lost[one]
                    ga, gb, who = _grams(starts[one], ends[one])
                    (g,) = span_hashes(points, ga, gb, two=False)
                    code[lost] = index.n + back
                    index.add(k1[one], k2[one])
                    own = np.bincount(who, self.weights[_bucket(g)], len(one)) + self.weights[_bucket(k1[one])]
                    sums = np.concatenate([sums, own])
                    counts = np.concatenate([counts, 1.0 + np.bincount(who, minlength=len(one))])
                pairs, here = _pairs(k1, at)
                total, n = sums[code], counts[code]
                total[here] += self.weights[_bucket(pairs)]
                n[here] += 1
                run = np.concatenate([[0.0], np.cumsum(total)]), np.concatenate([[0.0], np.cumsum(n)])
                logit = (run[0][at[1:]] - run[0][at[:-1]]) / np.maximum(run[1][at[1:]] - run[1][at[:-1]], 1)
            return 1 / (1 + np.exp(-np.clip(logit + self.bias, -500, 500)))

        def score(texts: list[str], span: int = 1 << 19) -> np.ndarray:
            out, i = [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= span):
                    size += len(texts[j])
                    j += 1
                out.append(part(texts[i:j]))
                i = j
            return np.concatenate(out) if out else np.empty(0)

        return score


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fit vectors and layer by stochastic gradient descent over documents in blocks of BATCH."""
    rng = np.random.default_rng(SEED)
    if not len(labels):
        return Model(np.zeros(BUCKETS), 0.0)
    prior = np.clip(labels.mean(), 0.01, 0.99)
    table = np.ascontiguousarray(rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32).T / DIM)  # one row a dimension
    layer = rng.uniform(-1, 1, (2, DIM)).astype(np.float32)
    bias = np.array([np.log(1 - prior), np.log(prior)], np.float32)
    steps, done = EPOCHS * -(-len(labels) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            ids = np.concatenate([features[i][0] for i in pick])
            doc = np.repeat(np.arange(len(pick)), [len(features[i][0]) for i in pick])
            share = np.concatenate([features[i][1] / max(features[i][1].sum(), 1) for i in pick]).astype(np.float32)
            mean = np.zeros((len(pick), DIM), np.float32)
            for d in range(DIM):
                mean[:, d] = np.bincount(doc, table[d][ids] * share, len(pick))
            logits = mean @ layer.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            grad = p @ layer
            layer -= rate * 0.02 * (p.T @ mean)
            bias -= 0.02 * p.mean(0)
            step = np.float32(-rate) * share
            for d in range(DIM):
                np.add.at(table[d], ids, step * grad[doc, d])
    return Model((layer[1] - layer[0]) @ table, bias[1] - bias[0])


def held_out() -> Column:
    """True where crc32 of the id's decimal text is divisible by 5; rows without id are held out as well."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [featurize(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("drawn", "doc_id", "print", "quality")),
                *(pa.array([f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in (0, 1)),
            ],
            ["drawn", "doc_id", "print", "quality", "ids", "counts"],
        )


def _trained(max_features: int):
    """The model of a sample's features, which come in the order of their draw: weights as bytes, and the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, labels, total = [], [], 0
        for batch in batches:
            ids, counts = batch.column("ids"), batch.column("counts")
            for i, label in enumerate(batch.column("quality").to_pylist()):
                total += len(ids[i])
                if total <= max_features:
                    features.append((ids[i].values.to_numpy().copy(), counts[i].values.to_numpy().copy()))
                    labels.append(label)
        model = train(features, np.array(labels, int))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, max_features: int = TRAIN_FEATURES) -> Model:
    """Learn ``labels.quality`` from the texts of at most ``train_docs`` labelled documents.

    The sample is drawn by a hash of the id among labelled rows that are not held out, so it is the same
    on every run. An id that is labelled twice counts with its larger label; other labels than 0 and 1 and
    nulls are ignored; of an id with several texts one is learned from. Whole texts become sparse counts on
    the executors, and one task learns from them: documents in the order of the draw, as long as they have
    no more than ``max_features`` distinct features together, so memory is bounded whatever their length.
    Only the model, four bytes a bucket, reaches the driver.
    """
    known = labels.where("quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    sample = known.withColumn("drawn", F.xxhash64("doc_id", F.lit(SEED))).orderBy("drawn", "doc_id").limit(train_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most train_docs rows
    texts = texts.select(F.col("drawn"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "quality", "text")
    counted = texts.mapInArrow(lean(_features, "text"), "drawn long, doc_id long, print long, quality int, ids array<int>, counts array<int>")
    one = counted.groupBy("doc_id").agg(F.min_by(F.struct("drawn", "quality", "ids", "counts"), "print").alias("c")).select("doc_id", "c.*")
    counted = one.repartition(1).sortWithinPartitions("drawn", "doc_id")  # at most train_docs rows
    row = counted.mapInArrow(lean(_trained(max_features)), "weights binary, bias double").first()
    return Model(np.zeros(BUCKETS), 0.0) if row is None else Model(np.frombuffer(row["weights"], np.float32), row["bias"])


def score(text: Column, model: Model) -> Column:
    """Score of a whole text in 0 to 1; null counts as empty and gets the prior."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model.scorer()
        try:
            for texts in batches:
                yield pd.Series(run(texts.fillna("").tolist()))
                release()
        finally:
            run = None  # its words go before what is free is handed back
            release()

    return scores(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Only the text is an input of a score. Repeated rows get equal scores; an empty table gives an empty
    table; without any usable label every score is 0.5. A score equal to the threshold predicts 1. Other
    columns are not read.
    """
    model = fit(docs, labels, train_docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that :func:`classify` predicts as 0; same columns, no shuffle of texts.

    Null and empty texts get the score of the bias alone and go or stay by it; repeated rows share their
    verdict, ties at the threshold stay; an empty table gives an empty table; all other columns are kept
    as they are.
    """
    return docs.where(score(F.col("text"), fit(docs, labels)) >= threshold)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
