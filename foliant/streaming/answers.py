"""Questions as a stream: every micro-batch goes through the batch plan; the index side is static."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.functions import text as X
from foliant.plans.hybrid import Store, answer_questions
from foliant.runtime import drop_tables, mark

#: A spoken question ends after so many seconds; an answer after so many pieces and sentences.
SPEECH_SECONDS, STOP_PIECES, STOP_SENTENCES = 30, 40, 2


def read_questions(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of question files, at most ``files_per_batch`` to a micro-batch, so that a burst waits at the source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def answer_stream(
    questions: DataFrame, store: Store, sink: str, checkpoint: str, summarize: Callable | None = None, every: str | None = None
) -> StreamingQuery:
    """Answer a stream of (question_id, question, vector), until its input is used up or, with ``every``, at that
    interval until it is stopped. Answers are Parquet below ``sink``, one folder for each batch, so that a repeated
    batch replaces its own output. Batches run one after the other; their intermediate tables go with them."""

    def each(batch: DataFrame, number: int) -> None:
        since = mark()
        try:
            asked = batch.select("question_id", "question")
            out = answer_questions(asked, batch.select("question_id", "vector"), store, summarize)
            out.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            drop_tables(batch.sparkSession, since)

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def first_output(tokens: DataFrame) -> DataFrame:
    """(question_id, first_ts) of a stream of (question_id, ts, piece): when the first visible piece came."""
    return tokens.where(F.col("piece").rlike(r"\S")).groupBy("question_id").agg(F.min("ts").alias("first_ts"))


def partial_results(pieces: DataFrame, watermark: str = "1 minute", seconds: int = SPEECH_SECONDS) -> DataFrame:
    """(session_id, text, n_pieces, until) of a stream of (session_id, nth, ts, piece), for output mode ``update``.

    Each trigger re-emits the whole text so far of the sessions that grew; the last row of a session is its final
    result. Pieces that come ``seconds`` or more after the session's ``started`` are not part of it.
    """
    live = pieces.withWatermark("ts", watermark).where(F.col("ts") < F.col("started") + F.make_dt_interval(secs=F.lit(seconds)))
    said = F.sort_array(F.collect_set(F.struct("nth", "piece")))["piece"]
    return live.groupBy("session_id", "started").agg(X.one_line(F.array_join(said, " ")).alias("text"), F.count("*").alias("n_pieces"), F.max("ts").alias("until"))


def stopped_early(pieces: DataFrame, least: int = STOP_PIECES, sentences: int = STOP_SENTENCES) -> DataFrame:
    """(question_id, answer, n_pieces, early) of (question_id, nth, piece): a reply ends at the first piece from the
    ``least``-th on with which the text has ``sentences`` terminal marks and is complete; without one it is whole."""
    order = W.partitionBy("question_id").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = pieces.withColumns({
        "made": F.count("*").over(order), "marks": F.sum(F.regexp_count("piece", F.lit("[.!?]"))).over(order),
        # what the text ends with is what the last piece that is not blank ends with
        "ends": F.last(F.when(F.col("piece").rlike(r"[^ \n\r\t]"), X.is_complete_sentence("piece")), ignorenulls=True).over(order),
    })
    stops = (F.col("made") >= least) & (F.col("marks") >= sentences) & F.coalesce("ends", F.lit(False))
    before = W.partitionBy("question_id").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("stop", stops).withColumn("over", F.coalesce(F.bool_or("stop").over(before), F.lit(False))).where("not over")
    text = F.array_join(F.sort_array(F.collect_list(F.struct("nth", "piece")))["piece"], "")
    return rows.groupBy("question_id").agg(text.alias("answer"), F.count("*").alias("n_pieces"), F.bool_or("stop").alias("early"))
