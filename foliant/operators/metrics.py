"""Roll-up of stage timings per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import duration_text

#: Stages of a question, by group.
RAG = ["question_preparation", "embedding", "retrieval", "evidence_check", "answer_routing"]
MODEL = [
    "context_preparation", "prompt_formatting", "tokenization", "prefill", "generation", "streaming", "finalization", "validation",
]
REST = ["companion_summary", "answer_formatting", "image_lookup", "total"]

#: Lines of the timing report, by group.
REPORT = [
    ("RAG", "rag", [
        ("Input preparation", "question_preparation"), ("Query embedding", "embedding"), ("Hybrid retrieval", "retrieval"),
        ("Evidence validation", "evidence_check"), ("Evidence routing", "answer_routing"),
    ]),
    ("Model", "companion_summary", [
        ("First token latency (SEND → token)", "first_token"), ("Context selection", "context_preparation"), ("Prompt formatting", "prompt_formatting"),
        ("Tokenization", "tokenization"), ("Prompt prefill", "prefill"), ("Token generation", "generation"), ("Token streaming", "streaming"),
        ("Output finalization", "finalization"), ("Grounding validation", "validation"), ("Model orchestration", "model_overhead"),
    ]),
    ("Output", "output", [
        ("Fallback/context formatting", "answer_formatting"), ("Image lookup", "image_lookup"), ("Output orchestration overhead", "pipeline_overhead"),
    ]),
]


def rollup(timings: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, stage, nanos) in long form to one row of sums, with group totals and what is left unmeasured."""
    wide = timings.groupBy(key).pivot("stage", [*RAG, *MODEL, *REST]).agg(F.sum("nanos")).fillna(0)
    total = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    out = wide.withColumn("rag", total(RAG))
    out = out.withColumn("model_overhead", F.greatest(F.lit(0), F.col("companion_summary") - total(MODEL)))
    measured = F.col("rag") + F.col("companion_summary") + F.col("answer_formatting") + F.col("image_lookup")
    out = out.withColumn("pipeline_overhead", F.greatest(F.lit(0), F.col("total") - measured))
    return out.withColumn("output", F.col("answer_formatting") + F.col("image_lookup") + F.col("pipeline_overhead"))


def report(rolled: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, report): the roll-up as readable lines, three groups and the total.

    Where ``rolled`` has a column ``first_token`` (nanoseconds from the question to the first token, 0 or null if
    none came) the model's part begins with it, else with 'not produced'.
    """
    first = F.col("first_token") if "first_token" in rolled.columns else F.lit(None).cast("long")
    parts = []
    for title, total, lines in REPORT:
        parts.append(F.concat(F.lit(f"{title} — "), duration_text(total)))
        for name, c in lines:
            value = F.when(first > 0, duration_text(first)).otherwise(F.lit("not produced")) if c == "first_token" else duration_text(c)
            parts.append(F.concat(F.lit(f"  {name}: "), value))
        parts.append(F.lit(""))
    parts.append(F.concat(F.lit("Total: "), duration_text("total")))
    return rolled.select(key, F.concat_ws("\n", F.lit("Response time analysis"), F.lit(""), *parts).alias("report"))
