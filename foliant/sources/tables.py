"""Canonical tables (pages, chunks, vectors, questions, images) over the test tables, and table checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import fixed_values as V

#: more lines than a document, and more turns than a conversation, may have; more of them are an error
LINES, TURNS = 100_000, 1000


def pair_id(a: str, b: str, limit: int) -> Column:
    """One id for (a, b); a ``b`` outside 0 to limit - 1 would be another pair's id and raises an error."""
    wrong = F.raise_error(F.concat(F.lit(f"{b} must be 0 to {limit - 1}, not "), F.col(b).cast("string"))).cast("long")
    return F.when(F.col(b).between(0, limit - 1), F.col(a) * limit + F.col(b)).otherwise(F.when(F.col(b).isNotNull(), wrong))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, manual, page_number: documents of a source are its manual's pages, numbered by id."""
    number = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.select(F.col("doc_id").alias("page_id"), F.coalesce("source", F.lit("")).alias("manual"), number.alias("page_number"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, page_id, chunk_index, section, text: the non-blank lines of documents."""
    title = F.substring(F.substring_index(F.substring_index("text", "\n", 1), ".", 1), 1, 80)
    lines = read(spark, sf_dir, "documents").select("doc_id", title.alias("section"), F.posexplode(F.split("text", "\n")))
    return lines.where(F.trim("col") != "").select(
        pair_id("doc_id", "pos", LINES).alias("chunk_id"), F.col("doc_id").alias("page_id"),
        F.col("pos").alias("chunk_index"), "section", F.col("col").alias("text"),
    )


def _first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First chunk of every row of documents: what :func:`chunks` would make of its first non-blank line, without the other lines."""
    blank = F.regexp_extract("text", r"\A[ \n]*\n", 0)
    line = F.substring_index(F.substr("text", F.length(blank) + 1), "\n", 1)
    title = F.substring(F.substring_index(F.substring_index("text", "\n", 1), ".", 1), 1, 80)
    pos = F.length(blank) - F.length(F.replace(blank, F.lit("\n"), F.lit("")))
    lines = read(spark, sf_dir, "documents").select("doc_id", title.alias("section"), pos.alias("pos"), line.alias("text")).where(F.trim("text") != "")
    return lines.select(pair_id("doc_id", "pos", LINES).alias("chunk_id"), F.col("doc_id").alias("page_id"), F.col("pos").alias("chunk_index"), "section", "text")


def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of every page."""
    first = F.min_by(F.struct("chunk_id", "chunk_index", "section", "text"), "chunk_index")
    return _first_lines(spark, sf_dir).groupBy("page_id").agg(first.alias("c")).select("page_id", "c.*")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, page_id, vector: a stored vector belongs to the first chunk of the page of its id."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vector"))
    return _first_lines(spark, sf_dir).groupBy("page_id").agg(F.min("chunk_id").alias("chunk_id")).join(v, "page_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, conv_id, question: what users say."""
    said = read(spark, sf_dir, "conversations").where("role = 'user'")
    return said.select(pair_id("conv_id", "turn", TURNS).alias("question_id"), "conv_id", F.col("text").alias("question"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, vector: the sum of two stored vectors (cosine does not see its length)."""
    q = questions(spark, sf_dir)
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = read(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    q = q.crossJoin(F.broadcast(n)).withColumns({"va": F.col("conv_id") % F.col("n"), "vb": (F.col("conv_id") + 1) % F.col("n")})
    a, b = e.select(F.col("vec_id").alias("va"), F.col("v").alias("a")), e.select(F.col("vec_id").alias("vb"), F.col("v").alias("b"))
    return q.join(a, "va").join(b, "vb").select("question_id", F.zip_with("a", "b", lambda x, y: x + y).alias("vector"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, page_id, asset_path, thumbnail_path, caption, from parts."""
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").crossJoin(F.broadcast(n)).select(
        key.alias("image_id"), (key % F.col("n")).alias("page_id"), F.concat(F.lit("images/"), key, F.lit(".png")).alias("asset_path"),
        F.concat(F.lit("thumbs/"), key, F.lit(".png")).alias("thumbnail_path"), F.concat(F.lit("Fig. "), key, F.lit(" "), "p_name").alias("caption"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight ranked rows for every question, derived from ids alone, for the operators behind retrieval."""
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    q = questions(spark, sf_dir).crossJoin(F.broadcast(n)).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("position"))
    q = q.withColumn("page_id", (F.col("conv_id") * 7 + F.col("position") * 13) % F.col("n"))
    k = F.col("position")
    rows = q.join(first_chunks(spark, sf_dir), "page_id").join(pages(spark, sf_dir), "page_id")
    return rows.select(
        "question_id", "question", "position", "chunk_id", "manual", F.col("page_number").alias("page"), "section", "text",
        F.when(k % 4 != 3, k + 1).alias("vector_rank"), F.when(k % 3 != 2, k + 1).alias("lexical_rank"),
        F.when(k % 4 != 3, F.lit(0.40) + F.lit(0.05) * k + F.lit(0.01) * (F.col("conv_id") % 20)).alias("distance"),
    ).withColumn("score", F.lit(0.03) - F.lit(0.002) * k)


#: the tables that an index consists of
REQUIRED = ["manuals", "manual_chunks", "manual_chunks_fts", "manual_images", "manual_pages"]


def missing_tables(spark: SparkSession, required: list[str] | None = None) -> list[str]:
    """Required tables that the catalog does not have, in upper case."""
    have = {t.name.upper() for t in spark.catalog.listTables()}
    return sorted(t.upper() for t in required or REQUIRED if t.upper() not in have)


def validate_schema(spark: SparkSession, required: list[str] | None = None) -> None:
    if missing := missing_tables(spark, required):
        raise ValueError(f"required tables are missing: {', '.join(missing)}")


def parse_page_markdown(documents: DataFrame) -> DataFrame:
    """(doc_id, page_number, markdown) from texts with page markers, one row per page.

    Lines before the first marker and the lines '# Page N' are dropped; a repeated marker appends.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    mark = F.regexp_extract("line", V.PAGE_MARKER, 1)
    in_order = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("mark", F.when(mark != "", mark.cast("int")))
    lines = lines.withColumn("page_number", F.last("mark", ignorenulls=True).over(in_order))
    kept = lines.where("mark is null and page_number is not null").where(~F.col("line").rlike(r"^# Page \d+\s*$"))
    body = F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"], "\n")
    found = lines.where("mark is not null").select("doc_id", "page_number").distinct()
    text = kept.groupBy("doc_id", "page_number").agg(body.alias("markdown"))
    out = found.join(text, ["doc_id", "page_number"], "left")
    return out.select("doc_id", "page_number", F.regexp_replace(F.coalesce("markdown", F.lit("")), r"\A\s+|\s+\z", "").alias("markdown"))


def image_markdown(images_: DataFrame) -> DataFrame:
    """(page_id, markdown): the figures of each page under one heading, in id order."""
    from foliant.functions.text import is_blank

    caption = F.when(is_blank("caption"), F.concat(F.lit("Manual image "), "image_id")).otherwise(F.col("caption"))
    mark = F.format_string("<!-- atlas-image-id: %d -->\n![%s](manual-asset://%s)", F.col("image_id"), caption, F.col("asset_path"))
    figures = F.array_join(F.sort_array(F.collect_list(F.struct("image_id", mark.alias("m"))))["m"], "\n\n")
    return images_.groupBy("page_id").agg(F.concat(F.lit("#### Manual figures\n\n"), figures).alias("markdown"))


def page_map(pages_: DataFrame) -> DataFrame:
    """(manual, page_number, page_id): what ids the pages of a manual have; a number that is used twice is an error."""
    same = F.count("*") > 1
    wrong = F.raise_error(F.concat(F.lit("page number used twice: "), F.col("page_number").cast("string"))).cast("long")
    return pages_.groupBy("manual", "page_number").agg(F.when(same, wrong).otherwise(F.min("page_id")).alias("page_id"))


def images_by_page(images_: DataFrame) -> DataFrame:
    """(manual, page, images): the images of each page, an array in id order."""
    row = F.struct("image_id", "asset_path", "thumbnail_path", "caption")
    return images_.groupBy("manual", "page").agg(F.sort_array(F.collect_list(row)).alias("images"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, marked by side; empty when the tables are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


_POINTER = "_current"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the present version of a table; None if it was never written."""
    jvm, target, fs = _file_system(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(target, _POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The present version of a table that :func:`replace_table` wrote."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(version)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write a new version of the table at ``path`` and make it the present one; returns it.

    A version is a folder of its own; the pointer file that names the present one is written aside and renamed
    over the old one in a single step, where the file system can, so readers see the old table or the new one and a
    crash leaves the old one. The version before stays for readers that have begun; older ones are deleted.
    Of two writers the later pointer wins, and neither's table is torn.
    """
    spark = df.sparkSession
    jvm, target, fs = _file_system(spark, path)
    before = current_version(spark, path)
    name = f"v-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/{name}")
    Path = jvm.org.apache.hadoop.fs.Path
    aside = Path(target, f".{name}.pointer")
    stream = fs.create(aside, True)
    stream.write(bytearray(name.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(aside), context.makeQualified(Path(target, _POINTER)), options)
    for status in fs.listStatus(target):
        other = status.getPath().getName()
        if other.startswith("v-") and other != name and before is not None and other != before.rpartition("/")[2]:
            fs.delete(status.getPath(), True)
    return spark.read.parquet(f"{path}/{name}")
