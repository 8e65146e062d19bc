"""Sources that are not tables: documents to convert, images, audio blocks, phrase lists, files to install."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Samples of a block, blocks that may wait, the scale of 16-bit samples, the weight of a phrase.
BLOCK_SAMPLES, WAITING_BLOCKS, FULL_SCALE, PHRASE_SCORE = 1_600, 320, 32_768, 1.3
#: How files of an image format begin.
IMAGE_HEADS = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "webp": "52494646"}


def converted_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(name, page_number, markdown) of every file below ``path``, one row a page, by an extractor of page texts.

    The extractor runs on the executors, a file at a time; no PDF library comes with this package.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pages = extract(batch.column("content")[i].as_py())
                names = [batch.column("name")[i].as_py()] * len(pages)
                numbers = pa.array(range(1, len(pages) + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), numbers, pa.array(pages, pa.string())], ["name", "page_number", "markdown"])

    return files.mapInArrow(run, "name string, page_number int, markdown string")


def check_page_counts(pages: DataFrame, page_ids: DataFrame) -> None:
    """Every document (``name``) must have as many converted pages as the page table has."""
    a = pages.groupBy("name").agg(F.count("*").alias("converted"))
    b = page_ids.groupBy("name").agg(F.count("*").alias("known"))
    bad = a.join(b, "name", "full_outer").where(~F.col("converted").eqNullSafe(F.col("known"))).orderBy("name").limit(5).collect()
    if bad:
        raise ValueError(f"page counts differ: {[tuple(r) for r in bad]}")


def image_bytes(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, content) for each relative ``path`` wanted; null where the file is missing or is no image."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    base = F.lit(root.rstrip("/").removeprefix("file:").replace("///", "/"))
    at = F.substring(F.col("path"), F.instr("path", base) + F.length(base) + 1, F.length("path"))
    heads = [F.startswith(F.hex(F.substring("content", 1, 8)), F.lit(h)) for h in IMAGE_HEADS.values()]
    good = heads[0] | heads[1] | heads[2] | heads[3]
    found = files.select(at.alias("path"), F.when(good, F.col("content")).alias("content"))
    return wanted.select("path").join(found, "path", "left")


def scaled(samples: str | Column) -> Column:
    """16-bit samples as numbers from -1 to 1."""
    return F.transform(F.col(samples) if isinstance(samples, str) else samples, lambda x: (x / F.lit(float(FULL_SCALE))).cast("float"))


def pcm_blocks(files: DataFrame, samples: int = BLOCK_SAMPLES) -> DataFrame:
    """(path, block, samples) of (path, content) with little-endian 16-bit audio; the last block may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                data = np.frombuffer(content or b"", "<i2", len(content or b"") // 2)
                parts = [data[i : i + samples] for i in range(0, len(data), samples)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.int16()))], ["path", "block", "samples"]
                )

    return files.select("path", "content").mapInArrow(run, "path string, block int, samples array<smallint>")


def phrases(spark: SparkSession, path: str, score: float = PHRASE_SCORE) -> DataFrame:
    """(phrase, score) of a text file with one phrase a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("phrase"), F.lit(score).alias("score")).where("phrase <> ''")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a text file with ``token id`` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("token"), F.get(parts, F.lit(1)).cast("int").alias("id"))


def install_file(spark: SparkSession, source: str, target: str, size: int) -> bool:
    """Copy a file beside ``target`` and rename it there if it has ``size`` bytes; False if it was there already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    here, there, part = Path(source), Path(target), Path(f"{target}.part")
    fs = there.getFileSystem(conf)
    if fs.exists(there) and fs.getFileStatus(there).getLen() == size:
        return False
    fs.delete(part, False)
    jvm.org.apache.hadoop.fs.FileUtil.copy(here.getFileSystem(conf), here, fs, part, False, True, conf)
    if (got := fs.getFileStatus(part).getLen()) != size:
        fs.delete(part, False)
        raise ValueError(f"{source} has {got} bytes, not {size}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(part), context.makeQualified(there), options)
    return True
