"""The ingestion job: page-marked Markdown and image rows to chunks, vectors and index tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import fixed_values as V
from foliant.operators import ingest, retrieve
from foliant.runtime import materialize, numbered
from foliant.sources import tables as T


@dataclass
class IngestJob:
    """What a run needs. ``convert`` turns source files into page-marked Markdown; without it the folder
    ``markdown`` already holds such files, one document each."""

    markdown: str
    output: str
    vocabulary: dict[str, int]
    convert: Callable[[], None] | None = None
    chunk_tokens: int = V.CHUNK_TOKENS


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Token to line number of a vocabulary file, which is small by nature."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return {token: i for i, token in enumerate(text.split("\n")) if token}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): whole files, numbered by the order of their names; the texts are not sorted."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text"))
    return files.join(numbered(files.select("name"), "name", "doc_id"), "name").select("doc_id", "text")


def check_pages(pages: DataFrame, page_ids: DataFrame) -> None:
    """Parsed pages and the page table (doc_id, page_number, page_id) must be the same set."""
    both = pages.select("doc_id", "page_number", F.lit(1).alias("p")).join(
        page_ids.select("doc_id", "page_number", F.lit(1).alias("q")), ["doc_id", "page_number"], "full_outer"
    )
    bad = both.where("p is null or q is null").limit(5).collect()
    if bad:
        raise ValueError(f"page numbers differ from the page table: {[tuple(r)[:2] for r in bad]}")


def check_assets(images: DataFrame, files: DataFrame) -> None:
    """Every asset and thumbnail path must be among ``files`` (path); the first five missing are named."""
    used = images.select(F.explode(F.array("asset_path", "thumbnail_path")).alias("path")).distinct()
    missing = [r["path"] for r in used.join(files, "path", "left_anti").orderBy("path").limit(5).collect()]
    if missing:
        raise ValueError(f"image files are missing: {', '.join(missing)}")


def zip_strict(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of equal ordinal side by side; an ordinal that one side lacks is an error."""
    both = left.withColumn("in_left", F.lit(1)).join(right.withColumn("in_right", F.lit(1)), on, "full_outer")
    if not both.where("in_left is null or in_right is null").isEmpty():
        raise ValueError("the two sides differ in length")
    return both.drop("in_left", "in_right")


def run(spark: SparkSession, job: IngestJob, levels: DataFrame | None = None) -> DataFrame:
    """Build ``chunks``, ``tokens``, ``terms`` and ``corpus_stats`` below ``job.output``; returns the chunks.

    The index is stemmed and free of diacritics; ``terms`` has every term's document frequency. Each table is a new
    version that becomes the present one at once, so readers see whole tables only (``sources.tables.read_table``).
    """
    if job.convert is not None:
        job.convert()
    pages = T.parse_page_markdown(read_documents(spark, job.markdown))
    pages = pages.withColumn("markdown", ingest.udfs.clean_page(F.col("markdown")))
    if levels is not None:
        pages = ingest.promote_headings(pages, levels)
    packed = ingest.pack_chunks(ingest.section_state(materialize(pages, "pages")), job.vocabulary, job.chunk_tokens)
    order = W.partitionBy("doc_id").orderBy("page_number", "chunk_index")
    chunks = packed.select(
        "doc_id", (F.row_number().over(order) - 1).alias("nth"), F.col("doc_id").cast("string").alias("manual"),
        F.col("page_number").cast("long").alias("page"), "chunk_index", "section", F.col("markdown").alias("text"), "n_tokens",
    )
    chunks = chunks.select(T.pair_id("doc_id", "nth", T.LINES).alias("chunk_id"), "*").drop("nth")
    chunks = T.replace_table(chunks, f"{job.output}/chunks")
    index = T.replace_table(retrieve.index_tokens(chunks, stem=True), f"{job.output}/tokens")
    T.replace_table(retrieve.term_frequencies(index), f"{job.output}/terms")
    T.replace_table(retrieve.corpus_stats(index), f"{job.output}/corpus_stats")
    if index.count() != chunks.count():
        raise ValueError("the index does not have one row per chunk")
    return chunks


def summary(chunks: DataFrame) -> DataFrame:
    """Numbers of pages, chunks and figure mentions of a run."""
    return chunks.agg(
        F.count_distinct("doc_id", "page").alias("pages"), F.count("*").alias("chunks"),
        F.coalesce(F.sum(F.regexp_count("text", F.lit(V.FIGURE_MENTION))), F.lit(0)).alias("figures"),
    )
