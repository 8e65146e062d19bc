"""Ingestion: pages to blocks, section state over a document, token-budgeted chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import fixed_values as V
from foliant.functions import text as X
from foliant.functions import udfs


def promote_headings(pages: DataFrame, levels: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number, markdown) with the blocks that ``levels`` (doc_id, page_number, normalized, level) names as headings."""
    blocks = pages.select("doc_id", "page_number", F.posexplode(F.split("markdown", r"\n\s*\n")).alias("n", "block"))
    blocks = blocks.withColumn("block", X.strip("block")).where("block <> ''").withColumn("normalized", udfs.normalized_heading(F.col("block")))
    rows = blocks.join(levels, ["doc_id", "page_number", "normalized"], "left")
    heading = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), X.one_line("block"))
    rows = rows.withColumn("block", F.when(F.col("level").isNotNull(), heading).otherwise(F.col("block")))
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("n", "block")))["block"], "\n\n")
    return rows.groupBy("doc_id", "page_number").agg(joined.alias("markdown"))


def blocks(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, idx, block, hashes, title, norm: paragraphs, those of one-line headings taken apart."""
    rows = pages.select("doc_id", "page_number", F.posexplode(F.split("markdown", r"\n\s*\n")).alias("idx", "raw"))
    rows = rows.withColumn("block", X.strip("raw"))
    hashes = F.length(F.regexp_extract("block", V.HEADING, 1))
    title = F.regexp_extract("block", V.HEADING, 2)
    return rows.select(
        "doc_id", "page_number", "idx", "block", "raw", hashes.alias("hashes"), title.alias("title"),
        F.when(hashes > 0, udfs.normalized_heading(title)).alias("norm"),
    )


def _standalone_parent(block: str, raw: str):
    """A short line with a capital and without punctuation, which may stand for a lost heading."""
    line, words = X.one_line(block), X.word_count(block)
    short = (words >= 1) & (words <= 6) & (F.length(line) >= 4) & (F.length(line) <= 60)
    return F.when(~F.contains(F.col(raw), F.lit("\n")) & short & line.rlike(r"\p{Lu}") & ~line.rlike("[.!?;:,⇒]"), line)


def parents(rows: DataFrame) -> DataFrame:
    """Blocks with ``parent``: the chapter title that a block stands for, or null."""
    page = W.partitionBy("doc_id", "page_number").orderBy("idx")
    is_heading, next_norm, next_hashes = F.col("hashes") > 0, F.lead("norm").over(page), F.lead("hashes").over(page)
    rows = rows.withColumns({"next_norm": next_norm, "next_hashes": next_hashes})
    twin = is_heading & (F.col("hashes") == 2) & (F.col("next_hashes") == 2) & (F.col("next_norm") != V.FIGURES_HEADING)
    lost = ~is_heading & (F.col("next_norm") == V.INTRODUCTION_HEADING)
    heads = rows.where((F.col("hashes") > 0) & (F.col("norm") != V.FIGURES_HEADING))
    after = F.lead("norm").over(W.partitionBy("doc_id").orderBy("page_number", "idx"))
    heads = heads.withColumn("after", after).where(F.col("after") == V.INTRODUCTION_HEADING)
    heads = heads.where(~F.col("norm").isin(V.CALLOUTS) & ~F.startswith("norm", F.lit(V.QUALIFIER_PREFIX)))
    led = heads.select("doc_id", "page_number", "idx", F.col("title").alias("led"))
    rows = rows.join(led, ["doc_id", "page_number", "idx"], "left")
    parent = F.when(twin, F.col("title")).when(lost, _standalone_parent("block", "raw"))
    return rows.withColumn("parent", F.coalesce("led", parent)).drop("led", "next_norm", "next_hashes")


def section_state(pages: DataFrame) -> DataFrame:
    """Body blocks (doc_id, page_number, idx, body) with the chapter, topic and qualifier above them.

    Headings set values that later blocks carry: chapter and topic through the document, qualifier,
    callout and figures through the page. Documents are independent; one document is one window.
    """
    rows = parents(blocks(pages).where("block <> ''"))
    head, has = F.col("hashes") > 0, F.coalesce(F.col("parent"), F.lit("")) != ""
    kind = (
        F.when(~head & has, "parent").when(~head, "body").when(F.col("norm") == V.FIGURES_HEADING, "figures").when(has, "parent")
        .when(F.col("norm") == V.INTRODUCTION_HEADING, "topic").when(F.col("norm").isin(V.CALLOUTS), "callout")
        .when(F.startswith("norm", F.lit(V.QUALIFIER_PREFIX)), "qualifier").otherwise("topic")
    )
    rows = rows.withColumn("kind", kind)
    k, title = F.col("kind"), F.col("title")
    resets = k.isin("parent", "figures", "topic")
    events = {
        "chapter": F.when(k == "parent", F.col("parent")),
        "topic": F.when(k == "parent", F.lit("")).when(k == "topic", title),
        "qualifier": F.when(resets, F.lit("")).when(k == "qualifier", title),
        "callout": F.when(resets, F.lit("")).when(k == "callout", title),
        "figures": F.when(k == "figures", F.lit(True)).when(k != "body", F.lit(False)),
    }
    document = W.partitionBy("doc_id").orderBy("page_number", "idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    page = W.partitionBy("doc_id", "page_number").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = {n: F.last(e, ignorenulls=True).over(document if n in ("chapter", "topic") else page) for n, e in events.items()}
    rows = rows.withColumns({f"c_{n}": c for n, c in carried.items()})
    text = lambda n: F.coalesce(f"c_{n}", F.lit(""))
    above = F.when(F.coalesce("c_figures", F.lit(False)), F.lit(V.FIGURES_QUALIFIER)).when(text("callout") != "", text("callout")).otherwise(text("qualifier"))
    return rows.select(
        "doc_id", "page_number", "idx", "kind", F.when(k == "body", F.col("block")).alias("body"),
        text("chapter").alias("chapter"), text("topic").alias("topic"), above.alias("qualifier"),
    )


def _render(chapter: str, topic: str, qualifier: str, body: str) -> str:
    heads = [f"## {chapter}"] if chapter else []
    heads += [f"### {topic}"] if topic and topic != chapter else []
    heads += [f"#### {qualifier}"] if qualifier else []
    return "\n\n".join([*heads, body]).strip()


def pack_page(rows: list[tuple[str, str, str, str]], fallback: tuple[str, str], count, limit: int) -> list[tuple[tuple, str]]:
    """Chunks (context, text) of one page from its (chapter, topic, qualifier, body) blocks.

    Neighbouring blocks of one context share a chunk while its tokens stay within ``limit``; a block
    that is too long alone is cut at sentences, a sentence at words. ``count`` must be a constant plus a sum
    over the words that white space parts, as word pieces are: so what a chunk holds is added up, not counted again.
    """
    nothing = count("")
    size = lambda text: count(text) - nothing
    heads: dict[tuple, int] = {}

    def room(context: tuple) -> int:
        if context not in heads:
            heads[context] = limit - nothing - size(_render(*context, ""))
        return heads[context]

    def gather(parts: list[str], context: tuple, deeper: bool) -> Iterator[tuple[str, int]]:
        held, used = [], 0
        for part in parts:
            own = size(part)
            if held and used + own > room(context):
                yield " ".join(held), used
                held, used = [], 0
            if deeper and own > room(context):
                yield from gather(part.split(), context, False)
            elif part:
                held, used = [*held, part], used + own
        if held:
            yield " ".join(held), used

    out: list[tuple[tuple, list[str], int]] = []
    for *context, body in rows:
        context, own = tuple(context), size(body)
        whole = [(body, own)]
        cut = own > room(context)
        for piece, n in gather(re.split(V.SENTENCE_END, re.sub(r"\s+", " ", body).strip()), context, True) if cut else whole:
            if out and out[-1][0] == context and out[-1][2] + n <= room(context):
                out[-1] = (context, [*out[-1][1], piece], out[-1][2] + n)
            else:
                out.append((context, [piece], n))
    return [(context, "\n\n".join(parts)) for context, parts, _ in out] or [((*fallback, ""), V.NO_TEXT)]


def pack_chunks(state: DataFrame, vocabulary: dict[str, int], limit: int = V.CHUNK_TOKENS) -> DataFrame:
    """doc_id, page_number, chunk_index, section, markdown, n_tokens from :func:`section_state`.

    A page without body gives one placeholder under the carried chapter and topic. A chunk over the limit
    (one word longer than the budget) is an error.
    """
    schema = "doc_id long, page_number int, chunk_index int, section string, markdown string, n_tokens int"

    def page(tokenizer: udfs.WordPiece, key: tuple, blocks_: list[tuple]) -> Iterator[tuple]:
        last = blocks_[-1]
        body = [b[1:] for b in blocks_ if b[0] == "body"]
        for i, (context, text) in enumerate(pack_page(body, (last[1], last[2]), tokenizer.count, limit)):
            markdown = _render(*context, text)
            if (n := tokenizer.count(markdown)) > limit:
                raise ValueError(f"chunk exceeds the token budget on page {key[1]}: {n}")
            yield (*key, i, context[1] or context[0], markdown, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = udfs.kept_tokenizer(vocabulary)  # what it learns of words serves all pages
        names = ["doc_id", "page_number", "kind", "chapter", "topic", "qualifier", "body"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
        held, key = [], None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "page_number", "chunk_index", "section", "markdown", "n_tokens"])

        for batch in batches:
            out = []
            for doc, number, *block in zip(*(batch.column(n).to_pylist() for n in names)):
                if key != (doc, number):
                    if held:
                        out += page(tokenizer, key, held)
                    held, key = [], (doc, number)
                held.append(tuple(block))
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(list(page(tokenizer, key, held)))

    rows = state.repartition("doc_id", "page_number").sortWithinPartitions("doc_id", "page_number", "idx")
    return rows.select("doc_id", "page_number", "kind", "chapter", "topic", "qualifier", "body").mapInArrow(run, schema)
