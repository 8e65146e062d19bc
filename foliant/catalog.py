"""Query name -> Spark callable and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant import fixtures as fx
from foliant.functions import fixed_values as V
from foliant.functions import text as X
from foliant.functions import udfs
from foliant.operators import answer, images, ingest, metrics, retrieve, route, voice
from foliant.plans import hybrid
from foliant.sources import tables as T

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL building blocks ------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in V.STOPWORDS) + "]"


def _terms(c: str, n: int) -> str:
    found = f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_-]{{2,}}'), lambda t: NOT list_contains({_STOP}, t))"
    return f"list_filter({found}, lambda t, i: list_position({found}, t) = i)[1:{n}]"


_CHUNKS = f"""lines AS (
  SELECT doc_id, source, substr(split_part(split_part(text, chr(10), 1), '.', 1), 1, 80) AS section, string_split(text, chr(10)) AS l FROM documents
), numbered AS (
  SELECT doc_id, coalesce(source, '') AS manual, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number FROM documents
), chunks AS MATERIALIZED (
  SELECT doc_id * {T.LINES} + i - 1 AS chunk_id, doc_id AS page_id, manual, page_number AS page, i - 1 AS chunk_index, section, l[i] AS text
  FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM lines) JOIN numbered USING (doc_id) WHERE trim(l[i], ' ') <> ''
), firsts AS MATERIALIZED (
  SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY chunk_index) = 1
)"""
_QUESTIONS = f"questions AS (SELECT conv_id * {T.TURNS} + turn AS question_id, conv_id, text AS question FROM conversations WHERE role = 'user')"
_EVIDENCE = f"""{_CHUNKS}, {_QUESTIONS}, evidence AS (
  SELECT question_id, question, CAST(k AS INTEGER) AS position, chunk_id, manual, page, section, text,
         CASE WHEN k % 4 <> 3 THEN k + 1 END AS vector_rank, CASE WHEN k % 3 <> 2 THEN k + 1 END AS lexical_rank,
         CASE WHEN k % 4 <> 3 THEN 0.40::DOUBLE + 0.05::DOUBLE * k + 0.01::DOUBLE * (conv_id % 20) END AS distance, 0.03::DOUBLE - 0.002::DOUBLE * k AS score
  FROM questions CROSS JOIN range(8) r(k) JOIN firsts ON page_id = (conv_id * 7 + k * 13) % (SELECT count(*) FROM documents)
)"""
_QVEC = """qvec AS (
  SELECT question_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] + z[2]) AS q FROM questions
  JOIN embeddings a ON a.vec_id = conv_id % (SELECT count(*) FROM embeddings) JOIN embeddings b ON b.vec_id = (conv_id + 1) % (SELECT count(*) FROM embeddings)
)"""
_KNN = f"""knn AS MATERIALIZED (
  SELECT question_id, chunk_id, distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS vector_rank
  FROM (SELECT question_id, chunk_id, 1 - list_cosine_similarity(q, embedding::DOUBLE[]) AS distance FROM qvec CROSS JOIN (
    SELECT chunk_id, embedding FROM firsts JOIN embeddings ON vec_id = page_id) v)
  QUALIFY vector_rank <= {V.VECTOR_CANDIDATES}
)"""
_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _grams(tokens: str) -> str:
    parts = [f"list_transform(generate_series(1, len({tokens}) - {n - 1}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))" for n in (1, 2, 3)]
    return "list_concat(" * 2 + parts[0] + ", " + parts[1] + "), " + parts[2] + ")"


def _bm25(*searches: tuple[str, str]) -> str:
    """CTEs that end in each search's ``name`` (question_id, chunk_id, bm25, lexical_rank) for the terms of a CTE.

    All searches share one look-up of the phrases that any of them asks.
    """
    asked = " UNION ".join(f"SELECT phrase FROM {name}_p" for name, _ in searches)
    found = f"""asked AS ({asked}), found AS MATERIALIZED (
  SELECT phrase, chunk_id, sum(w) AS f FROM (
    SELECT chunk_id, unnest({_grams("st")}) AS phrase, {V.SECTION_WEIGHT} AS w FROM tokens UNION ALL SELECT chunk_id, unnest({_grams("tt")}), {V.TEXT_WEIGHT} FROM tokens)
  WHERE phrase IN (SELECT phrase FROM asked) GROUP BY ALL
), weighed AS MATERIALIZED (
  SELECT phrase, chunk_id, idf * f * {V.BM25_K1 + 1} / (f + {V.BM25_K1} * ({1 - V.BM25_B} + {V.BM25_B} * n_tokens / avgdl)) AS part
  FROM found JOIN tokens USING (chunk_id) CROSS JOIN stats JOIN (
    SELECT phrase, ln((n_docs - df + 0.5) / (df + 0.5)) AS raw, CASE WHEN raw <= 0 THEN {V.MIN_IDF} ELSE raw END AS idf
    FROM (SELECT phrase, count(*) AS df FROM found GROUP BY phrase) CROSS JOIN stats) USING (phrase)
)"""
    return ", ".join([*(_asked(*s) for s in searches), found, *(_ranked(name) for name, _ in searches)])


def _asked(name: str, terms: str) -> str:
    pairs = "list_transform(generate_series(1, len(terms) - 1), lambda i: terms[i] || ' ' || terms[i + 1])"
    return f"""{name}_p AS MATERIALIZED (
  SELECT question_id, phrase, count(*) AS n FROM (
    SELECT question_id, array_to_string(regexp_extract_all(p, '[\\p{{L}}\\p{{N}}]+'), ' ') AS phrase
    FROM (SELECT question_id, unnest(list_concat({pairs}, terms)) AS p FROM {terms})) WHERE phrase <> '' GROUP BY ALL)"""


def _ranked(name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT question_id, chunk_id, bm25, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9), chunk_id) AS lexical_rank
  FROM (SELECT question_id, chunk_id, -sum(n * part) AS bm25 FROM weighed JOIN {name}_p USING (phrase) GROUP BY ALL)
  QUALIFY lexical_rank <= {V.FTS_CANDIDATES}
)"""


_TOKENS = f"""tokens AS MATERIALIZED (SELECT chunk_id, {_WORDS.format("section")} AS st, {_WORDS.format("text")} AS tt, len(st) + len(tt) AS n_tokens FROM chunks),
stats AS (SELECT count(*) AS n_docs, avg(n_tokens) AS avgdl FROM tokens)"""
_HAY = "lower(coalesce(section, '') || ' ' || coalesce(text, ''))"


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names}))"


# --- Text ---------------------------------------------------------------------------------------------------------

@_register("content_terms", f"SELECT doc_id, t[i] AS term, i AS pos FROM (SELECT doc_id, {_terms('text', 14)} AS t FROM documents), unnest(generate_series(1, len(t))) u(i)")
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.content_terms("text", V.ORIGINAL_TERMS)).alias("p", "term"))
    return rows.select("doc_id", "term", (F.col("p") + 1).cast("long").alias("pos"))


_INJ = V.INJECTION.replace("'", "''")


@_register("question_screen", f"""WITH q AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM {_values(fx.SCREEN, 'conv_id, turn, text')})
SELECT conv_id, turn, CASE WHEN length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) < 2 OR regexp_matches(coalesce(text, ''), '{_INJ}') THEN ''
  ELSE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) END AS prepared FROM q""")
def question_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    q = q.unionByName(spark.createDataFrame(fx.SCREEN, "conv_id long, turn int, text string"))
    return q.select("conv_id", "turn", X.prepared_question("text").alias("prepared"))


@_register("clean_markdown", f"""WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM {_values(fx.MARKDOWN, 'id, text')}),
a AS (SELECT id, regexp_replace(coalesce(text, ''), '(?s)<!--.*?-->', '', 'g') AS t FROM t),
b AS (SELECT id, regexp_replace(t, '!\\[([^\\]]*)\\]\\(manual-asset://[^)]+\\)', 'Figure: \\1', 'g') AS t FROM a),
c AS (SELECT id, regexp_replace(t, '(?m)^#{{1,6}}\\s+.*(?:\\r?\\n|$)', '', 'g') AS t FROM b),
d AS (SELECT id, regexp_replace(regexp_replace(t, '[\\t ]+', ' ', 'g'), ' *\\r?\\n *', chr(10), 'g') AS t FROM c)
SELECT id, trim(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS cleaned FROM d""")
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return t.unionByName(spark.createDataFrame(fx.MARKDOWN, "id long, text string")).select("id", X.clean_text("text").alias("cleaned"))


def _sql_clean_line(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[\\t ]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


@_register("sentence_scores", f"""WITH {_EVIDENCE}, s AS (
  SELECT question_id, position, {_terms('question', V.FOCUS_TERMS)} AS terms, position = 0 AS is_primary,
         string_split(regexp_replace({_sql_clean_line('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM evidence
), x AS (SELECT *, i, trim(l[i], ' ') AS sentence, lower(sentence) AS low FROM s, unnest(generate_series(1, len(l))) u(i))
SELECT question_id, position, i - 1 AS nth, sentence,
  CAST(2 * len(list_filter(terms, lambda t: contains(low, t) OR (length(t) >= 4 AND contains(low, t[1:4]))))
  + CASE WHEN regexp_matches(low, '{V.URGENT}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(low, '{V.ACTION}') THEN 3 ELSE 0 END
  + CASE WHEN contains(low, 'immediately') THEN 2 ELSE 0 END - CASE WHEN contains(low, 'including') THEN 2 ELSE 0 END
  + CASE WHEN is_primary THEN 4 ELSE 0 END AS INTEGER) AS sentence_score FROM x WHERE length(sentence) >= {V.SENTENCE_CHARS}""")
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.evidence(spark, sf_dir).select("question_id", "question", "position", F.posexplode(X.sentences("text")).alias("nth", "sentence"))
    rows = rows.where(F.length("sentence") >= V.SENTENCE_CHARS)
    score = X.sentence_score("sentence", X.content_terms("question", V.FOCUS_TERMS), F.col("position") == 0)
    return rows.select("question_id", "position", F.col("nth").cast("long").alias("nth"), "sentence", score.cast("int").alias("sentence_score"))


@_register("state_alignment", f"""SELECT id, CASE WHEN regexp_matches(q, '{V.ASKS_LIT}') AND regexp_matches(t, '{V.IS_LIT}') THEN 12 ELSE 0 END
  + CASE WHEN regexp_matches(q, '{V.FLASHES}') AND regexp_matches(t, '{V.FLASHES}') THEN 12 ELSE 0 END AS state,
  CASE WHEN regexp_matches(lower(question), '\\b(how|check|checking|inspect|inspection|verify|test)\\b')
    AND regexp_matches(lower(section), '\\b(check|checking|inspection|inspecting|procedure|testing)\\b') THEN 16 ELSE 0 END AS procedural
FROM (SELECT *, regexp_replace(lower(question), '\\s+', ' ', 'g') AS q, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t
  FROM (SELECT * FROM {_values(fx.ALIGNMENT, 'id, question, section, text')} UNION ALL
    SELECT -1 - c_custkey, c_comment_, 'How to check ' || c_mktsegment, 'It lights up, then ' || c_comment_ FROM (SELECT c_custkey, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN 'is it on' WHEN 1 THEN 'how to test' WHEN 2 THEN 'it blinks' ELSE 'other' END || ' ' || c_name AS c_comment_ FROM customer)))""")
def state_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(fx.ALIGNMENT, "id int, question string, section string, text string")
    k = F.col("c_custkey") % 4
    said = F.concat(F.when(k == 0, "is it on").when(k == 1, "how to test").when(k == 2, "it blinks").otherwise("other"), F.lit(" "), "c_name")
    more = T.read(spark, sf_dir, "customer").select(
        (-1 - F.col("c_custkey")).alias("id"), said.alias("question"), F.concat(F.lit("How to check "), "c_mktsegment").alias("section"), F.concat(F.lit("It lights up, then "), said).alias("text"),
    )
    rows = rows.unionByName(more)
    return rows.select("id", X.state_score("question", "text").alias("state"), X.procedural_score("question", "section").alias("procedural"))


@_register("usable_summaries", f"""SELECT id, a IS NOT NULL AND t <> '' AND NOT (NOT contains(t, chr(10)) AND regexp_matches(lower(t), '\\b(sorry|unable|cannot|can''t|couldn''t|do not know|don''t know|no information)\\b'))
  AND NOT (contains(lower(t), 'example facts:') OR contains(lower(t), 'example answer:') OR contains(lower(t), 'question:') OR contains(lower(t), 'manual facts:'))
  AND len(regexp_split_to_array(t, '\\s+')) BETWEEN 8 AND 120 AND regexp_matches(t, '(?s)^.*[.!?](?:\\s*\\[p\\. \\d+\\])*$') AS usable
FROM (SELECT *, trim(coalesce(a, ''), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM (
  SELECT * FROM {_values(fx.SUMMARIES, 'id, a')} UNION ALL SELECT 1000 + doc_id, l[1] FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""")
def usable_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-line answers, and the first line of every document as if a model had said it."""
    said = T.read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("a"))
    rows = spark.createDataFrame(fx.SUMMARIES, "id long, a string").unionByName(said)
    return rows.select("id", X.is_usable_summary("a").alias("usable"))


@_register("transcript_normalize")
def transcript_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = T.questions(spark, sf_dir).select(F.col("question_id").alias("id"), F.col("question").alias("raw"))
    said = said.unionByName(spark.createDataFrame(fx.TRANSCRIPTS, "id long, raw string"))
    return said.select("id", voice.normalized_transcript(F.col("raw")).alias("said"))


# --- Retrieval ----------------------------------------------------------------------------------------------------

@_register("chunk_page_join", f"WITH {_CHUNKS} SELECT chunk_id, page, chunk_index, section, length(text) AS chars FROM chunks")
def chunk_page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.paged_chunks(spark, sf_dir).select("chunk_id", "page", F.col("chunk_index").cast("long").alias("chunk_index"), "section", F.length("text").cast("long").alias("chars"))


@_register("image_page_join", """SELECT p_partkey AS image_id, page_number AS page, 'Fig. ' || p_partkey || ' ' || p_name AS caption FROM part
JOIN (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number FROM documents) ON doc_id = p_partkey % (SELECT count(*) FROM documents)""")
def image_page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.paged_images(spark, sf_dir).select("image_id", "page", "caption")


@_register("knn_topk", f"WITH {_CHUNKS}, {_QUESTIONS}, {_QVEC}, {_KNN} SELECT question_id, chunk_id, round(distance, 6) AS distance, vector_rank FROM knn")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.knn(T.vectors(spark, sf_dir), T.question_vectors(spark, sf_dir))
    return found.select("question_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("vector_rank").cast("long").alias("vector_rank"))


@_register("fts_stats", f"""WITH {_CHUNKS}, {_TOKENS} SELECT term, count(*) AS df, (SELECT n_docs FROM stats) AS n_docs, round((SELECT avgdl FROM stats), 6) AS avgdl
FROM (SELECT DISTINCT chunk_id, unnest(list_concat(st, tt)) AS term FROM tokens) GROUP BY term""")
def fts_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieve.index_tokens(T.chunks(spark, sf_dir))
    df = retrieve.term_frequencies(index)
    return df.crossJoin(F.broadcast(retrieve.corpus_stats(index))).withColumn("avgdl", F.round("avgdl", 6))


def _question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.questions(spark, sf_dir)
    return q.select("question_id", "question", X.content_terms("question", V.ORIGINAL_TERMS).alias("terms"))


_QTERMS = f"qterms AS (SELECT question_id, question, {_terms('question', V.ORIGINAL_TERMS)} AS terms FROM questions)"


@_register("bm25_topk", f"WITH {_CHUNKS}, {_QUESTIONS}, {_TOKENS}, {_QTERMS}, {_bm25(('lex', 'qterms'))} SELECT question_id, chunk_id, round(bm25, 6) AS bm25, lexical_rank FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieve.index_tokens(T.chunks(spark, sf_dir))
    found = retrieve.bm25(index, retrieve.question_phrases(_question_terms(spark, sf_dir)))
    return found.select("question_id", "chunk_id", F.round("bm25", 6).alias("bm25"), F.col("lexical_rank").cast("long").alias("lexical_rank"))


@_register("bm25_stemmed")
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieve.index_tokens(T.chunks(spark, sf_dir), stem=True)
    found = retrieve.bm25(index, retrieve.question_phrases(_question_terms(spark, sf_dir), stem=True))
    return found.select("question_id", "chunk_id", F.round("bm25", 6).alias("bm25"), "lexical_rank")


_FEEDBACK = f"""feedback AS (
  SELECT question_id, list(section ORDER BY vector_rank) AS sections FROM knn JOIN firsts USING (chunk_id)
  WHERE vector_rank <= {V.FEEDBACK_RANK} AND distance <= {V.FEEDBACK_DISTANCE} AND trim(section) <> '' GROUP BY question_id
), more AS (
  SELECT question_id, {_terms('question', V.EXPANDED_TERMS)} AS own, coalesce(flatten(list_transform(sections, lambda s: {_terms('s', V.EXPANDED_TERMS)})), []) AS extra
  FROM questions LEFT JOIN feedback USING (question_id)
), every AS (SELECT *, list_concat(own, extra) AS l, list_filter(l, lambda t, i: list_position(l, t) = i) AS d FROM more), wide AS (
  SELECT question_id, CASE WHEN len(own) < {V.EXPANDED_TERMS} THEN d[1:{V.EXPANDED_TERMS}] WHEN len(extra) = 0 OR list_contains(own, extra[1]) THEN own ELSE d END AS terms FROM every
)"""


@_register("feedback_terms", f"WITH {_CHUNKS}, {_QUESTIONS}, {_QVEC}, {_KNN}, {_FEEDBACK} SELECT question_id, array_to_string(terms, ' ') AS terms FROM wide")
def feedback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieve.knn(T.vectors(spark, sf_dir), T.question_vectors(spark, sf_dir))
    sections = retrieve.feedback_sections(near.join(T.first_chunks(spark, sf_dir).select("chunk_id", "section"), "chunk_id"))
    rows = T.questions(spark, sf_dir).join(sections, "question_id", "left")
    return rows.select("question_id", F.array_join(retrieve.expand_terms("question", "sections"), " ").alias("terms"))


_MERGED = f"""{_bm25(('one', 'qterms'), ('two', 'wide'))}, merged AS (
  SELECT coalesce(a.question_id, b.question_id) AS question_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id,
    coalesce(a.lexical_rank, b.lexical_rank + coalesce(n, 0)) AS lexical_rank
  FROM one a FULL JOIN two b ON a.question_id = b.question_id AND a.chunk_id = b.chunk_id
  LEFT JOIN (SELECT question_id, count(*) AS n FROM one GROUP BY 1) c ON c.question_id = b.question_id
)"""
_BOTH = f"{_CHUNKS}, {_QUESTIONS}, {_QVEC}, {_KNN}, {_FEEDBACK}, {_TOKENS}, {_QTERMS}, {_MERGED}"


@_register("lexical_rank_merge", f"WITH {_BOTH} SELECT question_id, chunk_id, lexical_rank FROM merged")
def lexical_rank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieve.knn(T.vectors(spark, sf_dir), T.question_vectors(spark, sf_dir))
    sections = retrieve.feedback_sections(near.join(T.first_chunks(spark, sf_dir).select("chunk_id", "section"), "chunk_id"))
    terms, index = _question_terms(spark, sf_dir), retrieve.index_tokens(T.chunks(spark, sf_dir))
    wide = terms.join(sections, "question_id", "left").withColumn("terms", retrieve.expand_terms("question", "sections"))
    return retrieve.merge_lexical(*retrieve.search_twice(index, terms, wide)).withColumn("lexical_rank", F.col("lexical_rank").cast("long"))


_FUSED = f"""fused AS (
  SELECT *, coalesce({V.VECTOR_WEIGHT}::DOUBLE / (60 + vector_rank), 0) + coalesce({V.LEXICAL_WEIGHT}::DOUBLE / (60 + lexical_rank), 0)
    + CASE WHEN vector_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN {V.BOTH_BONUS} ELSE 0 END
    + CASE WHEN lexical_rank IS NOT NULL AND len(terms) > 0 THEN {V.COVERAGE_BONUS} * len(list_filter(terms, lambda t: contains(hay, t))) / len(terms)
      + CASE WHEN len(list_filter(generate_series(1, len(terms) - 1), lambda i: contains(hay, terms[i] || ' ' || terms[i + 1]))) > 0 THEN {V.BIGRAM_BONUS} ELSE 0 END ELSE 0 END AS score
  FROM (SELECT coalesce(k.question_id, m.question_id) AS question_id, coalesce(k.chunk_id, m.chunk_id) AS chunk_id, vector_rank, lexical_rank, distance
    FROM knn k FULL JOIN merged m ON k.question_id = m.question_id AND k.chunk_id = m.chunk_id)
  JOIN (SELECT *, {_HAY} AS hay FROM chunks) USING (chunk_id) JOIN qterms USING (question_id)
)"""
_ORDER = "round(score, 12) DESC, vector_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, chunk_id"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.questions(spark, sf_dir).select("question_id", "question")
    return hybrid.retrieve_candidates(q, T.question_vectors(spark, sf_dir), fx.store(spark, sf_dir, stem=False))  # SQL has no stems


@_register("hybrid_fusion", f"WITH {_BOTH}, {_FUSED} SELECT question_id, chunk_id, page, vector_rank, lexical_rank, round(distance, 6) AS distance, round(score, 9) AS score FROM fused")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select(
        "question_id", "chunk_id", "page", F.col("vector_rank").cast("long").alias("vector_rank"), F.col("lexical_rank").cast("long").alias("lexical_rank"),
        F.round("distance", 6).alias("distance"), F.round("score", 9).alias("score"),
    )


_TOP = f"""paged AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY question_id, manual, page ORDER BY {_ORDER}) <= {V.PER_PAGE}),
topk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {_ORDER}) - 1 AS position FROM paged QUALIFY position < {V.TOP_K})"""


@_register("hybrid_search_topk", f"WITH {_BOTH}, {_FUSED}, {_TOP} SELECT question_id, position, chunk_id, page, section, round(score, 9) AS score FROM topk")
def hybrid_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieve.diversify(_fused(spark, sf_dir))
    return top.select("question_id", F.col("position").cast("long").alias("position"), "chunk_id", "page", "section", F.round("score", 9).alias("score"))


@_register("diverse_topk", f"""WITH {_EVIDENCE}, paged AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY question_id, manual, page % 4 ORDER BY {_ORDER}) <= 2)
SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY {_ORDER}) - 1 AS place FROM paged QUALIFY place < 6""")
def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.evidence(spark, sf_dir).withColumn("page", F.col("page") % 4).drop("position")
    return retrieve.diversify(rows).select("question_id", "chunk_id", F.col("position").cast("long").alias("place"))


_STRONG = f"""coalesce(bool_or(vector_rank IS NOT NULL AND distance IS NOT NULL AND ((lexical_rank IS NOT NULL AND distance <= {V.MAX_HYBRID_DISTANCE} AND score >= {V.MIN_HYBRID_SCORE})
  OR (vector_rank <= {V.SEMANTIC_RANK} AND distance <= {V.MAX_SEMANTIC_DISTANCE}))), false)"""


@_register("strong_evidence", f"""SELECT question_id, {_STRONG} AS strong FROM (
  SELECT question_id, vector_rank, lexical_rank, distance, score FROM (WITH {_EVIDENCE} SELECT * FROM evidence)
  UNION ALL SELECT * FROM {_values(fx.GATES, 'question_id, vector_rank, lexical_rank, distance, score')}) GROUP BY question_id""")
def strong_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.evidence(spark, sf_dir).select("question_id", "vector_rank", "lexical_rank", "distance", "score")
    gates = spark.createDataFrame(fx.GATES, "question_id long, vector_rank int, lexical_rank int, distance double, score double")
    return retrieve.strong_evidence(rows.unionByName(gates))


# --- Routing ------------------------------------------------------------------------------------------------------

_TARGET = f"""scored AS (
  SELECT *, list_sum(list_concat([0], list_transform({_terms('question', V.FOCUS_TERMS)}, lambda t: CASE WHEN contains(lower(section), t) THEN 3 WHEN contains(lower(text), t) THEN 1 ELSE 0 END)))
    + CASE WHEN regexp_matches(split_part(lower(question), chr(10), 1), '\\b(how|check|checking|inspect|inspection|verify|test)\\b') AND NOT contains(question, chr(10))
      AND regexp_matches(lower(section), '\\b(check|checking|inspection|inspecting|procedure|testing)\\b') THEN 16 ELSE 0 END
    + 3 * (CASE WHEN regexp_matches(regexp_replace(lower(question), '\\s+', ' ', 'g'), '{V.ASKS_LIT}') AND regexp_matches(lower(text), '{V.IS_LIT}') THEN 12 ELSE 0 END
      + CASE WHEN regexp_matches(lower(question), '{V.FLASHES}') AND regexp_matches(lower(text), '{V.FLASHES}') THEN 12 ELSE 0 END) - position AS target_score
  FROM evidence
), target AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY target_score DESC, position) = 1)"""
_MATCH = f"list_filter({_terms('question', V.FOCUS_TERMS)}, lambda t: contains({_HAY}, t) OR (length(t) >= 4 AND contains({_HAY}, t[1:4])))"


@_register("select_target", f"WITH {_EVIDENCE}, {_TARGET} SELECT question_id, chunk_id, CAST(target_score AS INTEGER) AS target_score FROM target")
def select_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.select_target(T.evidence(spark, sf_dir)).select("question_id", "chunk_id", "target_score")


@_register("select_complement", f"""WITH {_EVIDENCE}, {_TARGET}, m AS (SELECT *, {_MATCH} AS own FROM evidence), c AS (
  SELECT m.question_id, m.chunk_id, m.position, len(list_filter(m.own, lambda t: NOT list_contains(f.own, t))) AS gain
  FROM m JOIN target USING (question_id) JOIN m f ON f.question_id = m.question_id AND f.position = target.position
  WHERE m.chunk_id <> target.chunk_id AND (lower(m.section) <> lower(target.section) OR m.manual <> target.manual))
SELECT question_id, chunk_id, CAST(gain AS INTEGER) AS gain FROM c WHERE gain >= 2 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY gain DESC, position) = 1""")
def select_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.evidence(spark, sf_dir)
    return route.select_complement(rows, route.select_target(rows)).select("question_id", "chunk_id", "gain")


_PLACED = "placed AS (SELECT *, lower(section) AS section_key, row_number() OVER (PARTITION BY manual, lower(section) ORDER BY page, chunk_index, chunk_id) - 1 AS ordinal FROM chunks)"


@_register("section_window", f"""WITH {_EVIDENCE}, {_TARGET}, {_PLACED} SELECT t.question_id, p.chunk_id, row_number() OVER (PARTITION BY t.question_id ORDER BY p.ordinal) - 1 AS position,
  round(t.score, 9) AS score FROM target t JOIN placed o ON o.chunk_id = t.chunk_id JOIN placed p ON p.manual = o.manual AND p.section_key = o.section_key AND abs(p.ordinal - o.ordinal) <= {V.RADIUS}""")
def section_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = route.section_window(route.select_target(T.evidence(spark, sf_dir)), fx.paged_chunks(spark, sf_dir))
    return rows.select("question_id", "chunk_id", F.col("position").cast("long").alias("position"), F.round("score", 9).alias("score"))


@_register("nearest_section", f"""WITH {_EVIDENCE} SELECT question_id, position, e.chunk_id AS from_chunk, c.chunk_id, round(score * {V.REFERENCE_DECAY}, 9) AS score
FROM evidence e JOIN chunks c ON c.manual = e.manual AND lower(c.section) = lower(e.section)
QUALIFY row_number() OVER (PARTITION BY question_id, position ORDER BY abs(c.page - e.page - 3), c.chunk_index, c.page, c.chunk_id) = 1""")
def nearest_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.evidence(spark, sf_dir).withColumn("ref_id", F.struct("question_id", "position", F.col("chunk_id").alias("from_chunk")))
    found = route.nearest_section(rows.withColumn("page", F.col("page") + 3), fx.paged_chunks(spark, sf_dir))
    return found.select("ref_id.question_id", "ref_id.position", "ref_id.from_chunk", "chunk_id", F.round("score", 9).alias("score"))


@_register("evidence_merge", f"""WITH {_EVIDENCE}, u AS (
  SELECT question_id, chunk_id, 0 AS l, position FROM evidence WHERE position % 2 = 0 UNION ALL SELECT question_id, chunk_id, 1, position FROM evidence),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY l, position) = 1)
SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY l, position) - 1 AS place FROM d""")
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.evidence(spark, sf_dir)
    merged = route.merge_evidence(rows.where("position % 2 = 0"), rows)
    return merged.select("question_id", "chunk_id", F.col("position").cast("long").alias("place"))


@_register("reference_bfs")
def reference_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of an in-line manual, and, over the tables, of every question's evidence window."""
    context, manual = fx.reference_manual(spark)
    inline = route.expand_references(context, manual)
    chunks = fx.paged_chunks(spark, sf_dir)
    near = route.section_window(route.select_target(T.evidence(spark, sf_dir)), chunks)
    return inline.unionByName(route.expand_references(near, chunks)).select("question_id", "position", "chunk_id", "hop", F.round("score", 9).alias("score"))


# --- Answers ------------------------------------------------------------------------------------------------------

_FORMATTED = f"""d AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY position) = 1),
b AS (SELECT *, trim(regexp_replace(text, '[\\t ]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM d), k AS (
  SELECT *, coalesce(lag(lower(section)) OVER (PARTITION BY question_id ORDER BY position), '') AS prev FROM b WHERE trim(body) <> ''
), formatted AS (SELECT question_id, trim(string_agg(CASE WHEN lower(section) <> prev THEN CASE WHEN trim(section) = '' THEN 'Owner''s manual' ELSE section END || chr(10) ELSE '' END
  || '[p. ' || page || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY position), ' ' || chr(10)) AS answer FROM k GROUP BY question_id)"""


@_register("format_answer", f"WITH {_EVIDENCE}, {_FORMATTED} SELECT * FROM formatted")
def format_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.format_answer(T.evidence(spark, sf_dir))


@_register("summary_context")
def summary_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.evidence(spark, sf_dir)
    return answer.summary_context(rows, route.select_target(rows))


def _numbers(c: str) -> str:
    """Numbers not after a letter; RE2 has no look-behind, so a letter takes the digit behind it away."""
    return f"list_distinct(list_transform(regexp_extract_all(regexp_replace({c}, '([A-Za-z])[0-9]', '\\1 ', 'g'), '\\d+(?:[.,]\\d+)?'), lambda n: replace(n, ',', '.')))"


def _cited(c: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({c}, '(?i)\\[p\\.\\s*(\\d+)]', 1), lambda p: CAST(p AS BIGINT)))"


_KNOWN = f"array_to_string(list_transform({_cited('s')}, lambda p: coalesce(list_transform(list_filter(texts, lambda x: x.p = p), lambda x: x.t)[1], '')), '')"
_COLOURS = "list_transform(regexp_extract_all(s, '(?i)\\b(red|yellow|orange|green|white|blue)\\b'), lambda c: lower(c))"


@_register("answer_validation", f"""WITH {_EVIDENCE}, {_FORMATTED}, said AS (
  SELECT * FROM {_values(fx.ANSWERS, 'question_id, answer')} UNION ALL SELECT question_id, answer FROM formatted
), seen AS (SELECT question_id, position, page, section, text FROM evidence UNION ALL SELECT * FROM {_values(fx.ANSWER_EVIDENCE, 'question_id, position, page, section, text')}
), by_page AS (SELECT question_id, page, string_agg(section || ' ' || text || ' ', '' ORDER BY position) AS t FROM seen GROUP BY ALL
), facts AS (SELECT question_id, list(page) AS pages, string_agg(t, '') AS every, list({{'p': page, 't': lower(t)}}) AS texts FROM by_page GROUP BY question_id
), c AS (SELECT *, trim(coalesce(answer, ''), ' ' || chr(9) || chr(10) || chr(13)) AS plain, {_cited('answer')} AS cited FROM said LEFT JOIN facts USING (question_id))
SELECT CASE WHEN answer IS NOT NULL THEN sha256(answer) END AS answer_sha256, coalesce(plain <> '' AND NOT contains(answer, '{V.ABSTENTION.replace("'", "''")}')
  AND len(regexp_split_to_array(plain, '\\s+')) <= {V.ANSWER_WORDS} AND len(cited) > 0 AND len(list_filter(cited, lambda p: NOT list_contains(pages, p))) = 0
  AND len(list_filter({_numbers("regexp_replace(answer, '(?i)\\[p\\.\\s*(\\d+)]', '', 'g')")}, lambda n: NOT list_contains({_numbers('every')}, n))) = 0
  AND len(list_filter(regexp_split_to_array(answer, '\\n+'), lambda s: {_KNOWN} <> '' AND len(list_filter({_COLOURS}, lambda k: NOT contains({_KNOWN}, k))) > 0)) = 0, false) AS valid,
  question_id FROM c""")
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-line answers against in-line evidence, and every formatted answer against its own evidence."""
    answers, evidence = fx.answers_and_evidence(spark)
    rows = T.evidence(spark, sf_dir)
    own = answer.validate_answers(answer.format_answer(rows), rows)
    return answer.validate_answers(answers, evidence).unionByName(own).select("question_id", F.sha2("answer", 256).alias("answer_sha256"), "valid")


@_register("citation_numbers", """SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '([A-Za-z])[0-9]', '\\1 ', 'g'), '\\d+(?:[.,]\\d+)?'),
  lambda n: replace(n, ',', '.')))), ' ') AS numbers FROM documents""")
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(F.array_sort(X.numbers("text")), " ").alias("numbers"))


_PAGED_IMAGES = """paged_images AS (SELECT p_partkey AS image_id, manual, page_number AS page, 'Fig. ' || p_partkey || ' ' || p_name AS caption FROM part
  JOIN numbered ON doc_id = p_partkey % (SELECT count(*) FROM documents))"""


@_register("caption_images", f"""WITH {_EVIDENCE}, {_PAGED_IMAGES}, near AS (
  SELECT question_id, question, manual, p AS page, bool_or(p = page) AS exact FROM (SELECT DISTINCT question_id, question, manual, page, unnest([page - 1, page, page + 1]) AS p FROM evidence) WHERE p >= 1 GROUP BY ALL
), o AS (SELECT question_id, image_id, i.page, caption, len(list_filter({_terms('question', V.FOCUS_TERMS)}, lambda t: contains(lower(caption), t))) AS overlap, exact
  FROM near JOIN paged_images i ON i.manual = near.manual AND i.page = near.page)
SELECT question_id, image_id, page, caption, overlap + CASE WHEN exact THEN 0.5::DOUBLE ELSE 0 END AS image_score, row_number() OVER (PARTITION BY question_id ORDER BY image_score DESC, image_id) AS nth
FROM o WHERE overlap > 0 QUALIFY nth <= {V.IMAGES}""")
def caption_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.caption_images(T.evidence(spark, sf_dir), fx.paged_images(spark, sf_dir))
    return found.withColumn("nth", F.col("nth").cast("long"))


@_register("figure_images", f"""WITH {_CHUNKS}, {_QUESTIONS}, {_PAGED_IMAGES}, e AS (
  SELECT question_id, manual, question_id % 3 AS position, 'See Fig. ' || p_partkey || ' and fig. ' || (p_partkey + 1) AS text
  FROM questions JOIN part ON p_partkey = question_id % (SELECT count(*) FROM part) JOIN numbered ON doc_id = p_partkey % (SELECT count(*) FROM documents)),
s AS (SELECT question_id, manual, position, unnest(regexp_extract_all(text, '(?i)(?:⇒\\s*)?Fig\\.\\s*(\\d+)', 1)) AS figure FROM e),
f AS (SELECT question_id, manual, figure, min(position) AS seen FROM s GROUP BY ALL)
SELECT question_id, figure, image_id, row_number() OVER (PARTITION BY question_id ORDER BY seen, CAST(figure AS BIGINT)) AS nth
FROM f JOIN paged_images i ON i.manual = f.manual AND CAST(image_id AS VARCHAR) = figure""")
def figure_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with a text that names two figures of its part's manual, one of which may be another manual's."""
    shown = fx.paged_images(spark, sf_dir)
    n = F.broadcast(shown.agg(F.count("*").alias("n")))
    text = F.concat(F.lit("See Fig. "), F.col("image_id"), F.lit(" and fig. "), F.col("image_id") + 1)
    rows = T.questions(spark, sf_dir).crossJoin(n).withColumn("image_id", F.col("question_id") % F.col("n")).join(shown.select("image_id", "manual"), "image_id")
    rows = rows.select("question_id", "manual", (F.col("question_id") % 3).alias("position"), text.alias("text"))
    return images.figure_images(rows, shown).withColumn("nth", F.col("nth").cast("long"))


# --- Ingestion, metrics, checks -----------------------------------------------------------------------------------

@_register("page_marker_parse", f"""WITH d AS (SELECT * FROM {_values(fx.MARKED, 'doc_id, text')} UNION ALL
  SELECT 1000 + doc_id, '<!-- atlas-page: 1 -->' || chr(10) || regexp_replace(text, '\\n', chr(10) || '<!-- atlas-page: 2 -->' || chr(10)) FROM documents), l AS (SELECT doc_id, i, (string_split(text, chr(10)))[i] AS line FROM d, unnest(generate_series(1, len(string_split(text, chr(10))))) u(i)),
m AS (SELECT *, CAST(nullif(regexp_extract(line, '^<!-- atlas-page: (\\d+) -->$', 1), '') AS INTEGER) AS mark FROM l),
p AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS page_number FROM m)
SELECT doc_id, page_number, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (mark IS NULL AND NOT regexp_matches(line, '^# Page \\d+\\s*$')), ''), ' ' || chr(10)) AS markdown
FROM p WHERE page_number IS NOT NULL GROUP BY ALL""")
def page_marker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-line documents with markers, and every document of the table as two pages, its first line and the rest."""
    text = F.regexp_replace("text", r"\A([^\n]*)\n", "$1\n<!-- atlas-page: 2 -->\n")
    docs = T.read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat(F.lit("<!-- atlas-page: 1 -->\n"), text).alias("text"))
    return T.parse_page_markdown(spark.createDataFrame(fx.MARKED, "doc_id long, text string").unionByName(docs))


_CTRL = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32))
_CALLS = ", ".join(f"'{c}'" for c in V.CALLOUTS)
_HEAD = V.HEADING.replace("'", "''")


@_register("section_state", f"""WITH pages AS (
  SELECT doc_id, 1 AS page_number, '### ' || substr(l[1], 1, 40) || chr(10) || chr(10) || array_to_string(l, chr(10) || chr(10)) AS markdown
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) UNION ALL SELECT * FROM {_values(fx.PAGES, 'doc_id, page_number, markdown')}
), raws AS (SELECT doc_id, page_number, regexp_split_to_array(markdown, '\\n\\s*\\n') AS r FROM pages
), b AS (SELECT doc_id, page_number, i - 1 AS idx, r[i] AS raw, trim(r[i], {_CTRL}) AS block FROM raws, unnest(generate_series(1, len(r))) u(i)
), t AS (SELECT *, length(regexp_extract(block, '{_HEAD}', 1)) AS hashes, regexp_extract(block, '{_HEAD}', 2) AS title FROM b WHERE block <> ''
), n AS (SELECT *, CASE WHEN hashes > 0 THEN trim(regexp_replace(lower(nfc_normalize(title)), '[^a-z0-9]+', ' ', 'g'), ' ') END AS norm,
  trim(regexp_replace(block, '\\s+', ' ', 'g'), ' ') AS line FROM t
), p AS (SELECT *, lead(norm) OVER w AS next_norm, lead(hashes) OVER w AS next_hashes FROM n WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY idx)
), h AS (SELECT doc_id, page_number, idx, title AS led FROM (
  SELECT *, lead(norm) OVER (PARTITION BY doc_id ORDER BY page_number, idx) AS after FROM p WHERE hashes > 0 AND norm <> '{V.FIGURES_HEADING}')
  WHERE after = '{V.INTRODUCTION_HEADING}' AND norm NOT IN ({_CALLS}) AND NOT starts_with(norm, '{V.QUALIFIER_PREFIX}')
), q AS (SELECT p.*, coalesce(led, CASE WHEN hashes = 2 AND next_hashes = 2 AND next_norm <> '{V.FIGURES_HEADING}' THEN title
  WHEN hashes = 0 AND next_norm = '{V.INTRODUCTION_HEADING}' AND NOT contains(raw, chr(10)) AND len(string_split(line, ' ')) <= 6 AND length(line) BETWEEN 4 AND 60
    AND regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '[.!?;:,⇒]') THEN line END) AS parent
  FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND p.page_number = h.page_number AND p.idx = h.idx
), k AS (SELECT *, CASE WHEN hashes = 0 THEN CASE WHEN coalesce(parent, '') <> '' THEN 'parent' ELSE 'body' END WHEN norm = '{V.FIGURES_HEADING}' THEN 'figures'
  WHEN coalesce(parent, '') <> '' THEN 'parent' WHEN norm = '{V.INTRODUCTION_HEADING}' THEN 'topic' WHEN norm IN ({_CALLS}) THEN 'callout'
  WHEN starts_with(norm, '{V.QUALIFIER_PREFIX}') THEN 'qualifier' ELSE 'topic' END AS kind FROM q
), c AS (SELECT *, last_value(CASE WHEN kind = 'parent' THEN parent END IGNORE NULLS) OVER d AS chapter_,
  last_value(CASE kind WHEN 'parent' THEN '' WHEN 'topic' THEN title END IGNORE NULLS) OVER d AS topic_,
  last_value(CASE WHEN kind IN ('parent', 'figures', 'topic') THEN '' WHEN kind = 'qualifier' THEN title END IGNORE NULLS) OVER g AS qualifier_,
  last_value(CASE WHEN kind IN ('parent', 'figures', 'topic') THEN '' WHEN kind = 'callout' THEN title END IGNORE NULLS) OVER g AS callout_,
  last_value(CASE WHEN kind = 'figures' THEN true WHEN kind <> 'body' THEN false END IGNORE NULLS) OVER g AS figures_
  FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY page_number, idx ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY doc_id, page_number ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, CAST(idx AS INTEGER) AS idx, coalesce(chapter_, '') AS chapter, coalesce(topic_, '') AS topic,
  CASE WHEN coalesce(figures_, false) THEN '{V.FIGURES_QUALIFIER}' WHEN coalesce(callout_, '') <> '' THEN callout_ ELSE coalesce(qualifier_, '') END AS qualifier,
  CAST(length(block) AS INTEGER) AS chars FROM c WHERE kind = 'body'""")
def section_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.headed_pages(spark, sf_dir).unionByName(spark.createDataFrame(fx.PAGES, "doc_id long, page_number int, markdown string"))
    return ingest.section_state(pages).where("kind = 'body'").select("doc_id", "page_number", "idx", "chapter", "topic", "qualifier", F.length("body").alias("chars"))


@_register("chunk_pack")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.headed_pages(spark, sf_dir).unionByName(spark.createDataFrame(fx.PAGES, "doc_id long, page_number int, markdown string"))
    packed = ingest.pack_chunks(ingest.section_state(pages), fx.vocabulary())
    return packed.select("doc_id", "page_number", "chunk_index", "section", F.sha2("markdown", 256).alias("markdown_sha256"), "n_tokens")


@_register("wordpiece_tokens")
def wordpiece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "benchmark").select("item_id", udfs.wordpiece(F.col("text"), fx.vocabulary(), V.MAX_TOKENS).alias("e"))
    return rows.select("item_id", F.array_join(F.col("e.ids").cast("array<string>"), " ").alias("ids"), F.aggregate("e.mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_tokens"))


@_register("mean_pool_l2", """WITH p AS (SELECT label, list_transform(generate_series(1, 64), lambda i: 0) AS z, unnest(generate_series(1, 64)) AS i, embedding FROM embeddings),
m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM p GROUP BY ALL), n AS (SELECT label, sqrt(greatest(sum(v * v), 1e-12)) AS norm FROM m GROUP BY label)
SELECT label, i AS dim, round(v / norm, 6) AS value FROM m JOIN n USING (label)""")
def mean_pool_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of every label, of unit length; partial sums per dimension leave the tasks, not vectors."""
    e = T.read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    mean = e.groupBy("label", "p").agg(F.avg(F.col("v").cast("double")).alias("v"))
    pooled = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("p", "v")))["v"].alias("vector"))
    rows = pooled.select("label", F.posexplode(retrieve.l2_normalize("vector")).alias("p", "value"))
    return rows.select("label", (F.col("p") + 1).cast("long").alias("dim"), F.round("value", 6).alias("value"))


@_register("pooled_windows", """WITH p AS (SELECT vec_id, i, (CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 16] AS DOUBLE) + CAST(embedding[i + 32] AS DOUBLE)) / 3 AS v FROM embeddings, unnest(generate_series(1, 16)) u(i)),
n AS (SELECT vec_id, sqrt(greatest(sum(v * v), 1e-12)) AS norm FROM p GROUP BY vec_id) SELECT vec_id, i AS dim, round(v / norm, 6) AS value FROM p JOIN n USING (vec_id)""")
def pooled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked mean of each vector's four 16-wide parts, as a model's token outputs would be pooled."""
    e = T.read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(1), F.lit(49), F.lit(16)), lambda i: F.slice(F.col("embedding"), i, F.lit(16)).cast("array<double>")).alias("tokens"))
    pooled = retrieve.l2_normalize(retrieve.masked_mean("tokens", F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(0))))
    rows = e.select("vec_id", F.posexplode(pooled).alias("p", "value"))
    return rows.select("vec_id", (F.col("p") + 1).cast("long").alias("dim"), F.round("value", 6).alias("value"))


@_register("timing_rollup", """WITH t AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'embedding' WHEN 'purchase' THEN 'image_lookup' ELSE 'answer_formatting' END AS stage,
  CAST(round(value * 1000000) AS BIGINT) AS nanos FROM events UNION ALL SELECT user_id, 'total', CAST(round(value * 1500000) AS BIGINT) FROM events),
w AS (SELECT user_id, coalesce(sum(nanos) FILTER (stage IN ('retrieval', 'embedding')), 0) AS rag, coalesce(sum(nanos) FILTER (stage = 'image_lookup'), 0) AS i,
  coalesce(sum(nanos) FILTER (stage = 'answer_formatting'), 0) AS f, coalesce(sum(nanos) FILTER (stage = 'total'), 0) AS total FROM t GROUP BY user_id)
SELECT user_id, CAST(rag AS BIGINT) AS rag, CAST(greatest(0, total - rag - i - f) AS BIGINT) AS pipeline_overhead, CAST(i + f + greatest(0, total - rag - i - f) AS BIGINT) AS output, CAST(total AS BIGINT) AS total FROM w""")
def timing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events")
    stage = F.when(F.col("event_type") == "view", "retrieval").when(F.col("event_type") == "click", "embedding").when(F.col("event_type") == "purchase", "image_lookup").otherwise("answer_formatting")
    t = e.select("user_id", stage.alias("stage"), F.round(F.col("value") * 1000000).cast("long").alias("nanos"))
    t = t.unionByName(e.select("user_id", F.lit("total").alias("stage"), F.round(F.col("value") * 1500000).cast("long").alias("nanos")))
    return metrics.rollup(t, "user_id").select("user_id", "rag", "pipeline_overhead", "output", "total")


@_register("integrity_checks", f"""WITH {_CHUNKS}, {_PAGED_IMAGES} SELECT 'chunks' AS check_name, (SELECT count(*) FROM chunks) AS n UNION ALL
SELECT 'pages without chunks', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT page_id FROM chunks)) UNION ALL
SELECT 'images without page', (SELECT count(*) FROM part) - (SELECT count(*) FROM paged_images) UNION ALL
SELECT 'pages without vector', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) UNION ALL
SELECT 'vectors without page', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) UNION ALL
SELECT 'figure mentions', (SELECT coalesce(sum(len(regexp_extract_all(text, '\\bFig\\.\\s*(\\d+)\\b'))), 0) FROM documents) UNION ALL
SELECT 'changed rows', (SELECT 2 * count(*) FROM part WHERE p_partkey % 7 = 0) + (SELECT count(*) FROM part WHERE p_partkey % 7 = 1)""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = T.read(spark, sf_dir, "documents"), T.chunks(spark, sf_dir)
    vecs, imgs = T.read(spark, sf_dir, "embeddings"), T.images(spark, sf_dir)
    # a rebuild that loses some image rows and rewrites the captions of others
    caption = F.when(F.col("image_id") % 7 == 0, F.concat("caption", F.lit("!"))).otherwise(F.col("caption"))
    after = imgs.where("image_id % 7 <> 1").withColumn("caption", caption)
    page_ids = docs.select(F.col("doc_id").alias("page_id"))
    both = page_ids.select("page_id", F.lit(1).alias("p")).join(vecs.select(F.col("vec_id").alias("page_id"), F.lit(1).alias("v")), "page_id", "full_outer")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
    parts = [
        count(chunks, "chunks"), count(page_ids.join(chunks, "page_id", "left_anti"), "pages without chunks"),
        count(imgs.join(page_ids, "page_id", "left_anti"), "images without page"), count(both.where("v is null"), "pages without vector"),
        count(both.where("p is null"), "vectors without page"),
        docs.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(V.FIGURE_MENTION))), F.lit(0)).cast("long").alias("n")).select(F.lit("figure mentions").alias("check_name"), "n"),
        count(T.set_difference(imgs, after), "changed rows"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_register("distinct_pages", "SELECT doc_id, page, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '\\d+'), lambda n: CAST(n AS HUGEINT) % 50)) AS page FROM documents) GROUP BY ALL")
def distinct_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that an answer names (here: numbers of documents, as page numbers under 50), with their mentions."""
    named = F.transform(F.regexp_extract_all(X.text_or_empty("text"), F.lit(r"\d+"), F.lit(0)), lambda n: (n.cast("decimal(38,0)") % 50).cast("long"))
    return T.read(spark, sf_dir, "documents").select("doc_id", F.explode(named).alias("page")).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@_register("source_listing", f"""WITH {_EVIDENCE} SELECT question_id, sha256(string_agg('p. ' || page || CASE WHEN section <> '' THEN ' — ' || section ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY position)) AS listing_sha256
FROM evidence GROUP BY question_id""")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.source_listing(T.evidence(spark, sf_dir)).select("question_id", F.sha2("listing", 256).alias("listing_sha256"))


@_register("images_by_page", """SELECT manual, page_number AS page, count(*) AS n_images, sha256(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey)) AS ids_sha256
FROM part JOIN (SELECT doc_id, coalesce(source, '') AS manual, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number FROM documents) ON doc_id = p_partkey % (SELECT count(*) FROM documents)
GROUP BY ALL""")
def images_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.images_by_page(fx.paged_images(spark, sf_dir))
    ids = F.array_join(F.transform("images", lambda i: i["image_id"].cast("string")), ",")
    return rows.select("manual", "page", F.size("images").cast("long").alias("n_images"), F.sha2(ids, 256).alias("ids_sha256"))


@_register("page_map", """SELECT coalesce(source, '') AS manual, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, doc_id AS page_id FROM documents""")
def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.page_map(T.pages(spark, sf_dir)).withColumn("page_number", F.col("page_number").cast("long"))


@_register("page_diversity_stats", f"""WITH {_EVIDENCE} SELECT question_id, count(DISTINCT page) AS n_pages, max(n) AS most_on_page FROM (
  SELECT question_id, page, count(*) OVER (PARTITION BY question_id, page) AS n FROM evidence) GROUP BY question_id""")
def page_diversity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_page = T.evidence(spark, sf_dir).groupBy("question_id", "page").agg(F.count("*").alias("n"))
    return per_page.groupBy("question_id").agg(F.count("*").alias("n_pages"), F.max("n").alias("most_on_page"))


@_register("grounded_answers")
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path over a stemmed index: every user question to its answer, evidence and images."""
    q = T.questions(spark, sf_dir).select("question_id", "question")
    out = hybrid.answer_questions(q, T.question_vectors(spark, sf_dir), fx.store(spark, sf_dir))
    return out.select("question_id", F.sha2("text", 256).alias("answer_sha256"), F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"), F.coalesce(F.size("images"), F.lit(0)).alias("n_images"))
