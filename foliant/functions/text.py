"""Text functions as Column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import fixed_values as V

#: every character that Java's trim() removes
_LOW = "".join(map(chr, range(0x21)))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: str | Column) -> Column:
    """Without control characters and blanks at either end."""
    return F.btrim(col(c), F.lit(_LOW))


def is_blank(c: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(c), r"[\s\p{Z}]+", "") == ""


def content_terms(c: str | Column, limit: int) -> Column:
    """The first ``limit`` distinct content terms, in order."""
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(V.TOKEN), F.lit(0))
    stop = F.array(*map(F.lit, V.STOPWORDS))
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~F.array_contains(stop, t))), 1, limit)


def bigrams(terms: str | Column) -> Column:
    """Adjacent pairs, joined by a blank."""
    t = col(terms)
    rest = F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
    return F.filter(F.zip_with(t, rest, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())


def query_phrases(terms: str | Column) -> Column:
    """Phrases of a full-text query: pairs of adjacent terms, then the terms."""
    return F.concat(bigrams(terms), col(terms))


def haystack(section: str = "section", text: str = "text") -> Column:
    return F.lower(F.concat(text_or_empty(section), F.lit(" "), text_or_empty(text)))


def count_contained(terms: str | Column, text: Column) -> Column:
    return F.size(F.filter(col(terms), lambda t: F.contains(text, t)))


def is_injection(c: str | Column) -> Column:
    return text_or_empty(c).rlike(V.INJECTION)


def prepared_question(c: str | Column) -> Column:
    """Trimmed question, or '' when it is too short or tries to replace the instructions."""
    q = strip(text_or_empty(c))
    return F.when((F.length(q) < 2) | is_injection(q), F.lit("")).otherwise(q)


def clean_text(c: str | Column) -> Column:
    """Readable text of Markdown: comments, image links, headings and spare blanks removed."""
    t = F.regexp_replace(text_or_empty(c), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"!\[([^]]*)]\(manual-asset://[^)]+\)", "Figure: $1")
    t = F.regexp_replace(t, r"(?m)^#{1,6}\s+.*(?:\R|$)", "")
    t = F.regexp_replace(t, r"[\t ]+", " ")
    t = F.regexp_replace(t, r" *\R *", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def one_line(c: str | Column) -> Column:
    return strip(F.regexp_replace(col(c), r"\s+", " "))


def sentences(c: str | Column) -> Column:
    """Trimmed sentences of cleaned text on one line."""
    return F.transform(F.split(one_line(clean_text(c)), V.SENTENCE_END), strip)


def section_references(c: str | Column) -> Column:
    found = F.regexp_extract_all(text_or_empty(c), F.lit(V.SECTION_REFERENCE), F.lit(1))
    return F.transform(found, one_line)


def figure_references(c: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit(V.FIGURE_REFERENCE), F.lit(1)))


def cited_pages(c: str | Column) -> Column:
    found = F.regexp_extract_all(text_or_empty(c), F.lit(V.CITATION), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: p.cast("int")))


def without_citations(c: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(c), V.CITATION, "")


def attach_citation(answer: str | Column, page: str | Column) -> Column:
    """The answer with its own citations replaced by one verified page; a blank answer as it is."""
    cited = F.concat(strip(without_citations(answer)), F.lit(" [p. "), col(page).cast("string"), F.lit("]"))
    return F.when(is_blank(answer), col(answer)).otherwise(cited)


def numbers(c: str | Column) -> Column:
    found = F.regexp_extract_all(text_or_empty(c), F.lit(V.NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.translate(n, ",", ".")))


def colours(c: str | Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(V.COLOUR), F.lit(1)), F.lower))


def word_count(c: str | Column) -> Column:
    return F.size(F.split(strip(c), r"\s+"))


def procedural_score(question: str | Column, section: str | Column) -> Column:
    both = F.lower(text_or_empty(question)).rlike(V.ASKS_PROCEDURE) & F.lower(text_or_empty(section)).rlike(V.IS_PROCEDURE)
    return F.when(both, 16).otherwise(0)


def state_score(question: str | Column, text: str | Column) -> Column:
    q, t = (F.regexp_replace(F.lower(text_or_empty(c)), r"\s+", " ") for c in (question, text))
    lit = F.when(q.rlike(V.ASKS_LIT) & t.rlike(V.IS_LIT), 12).otherwise(0)
    return lit + F.when(q.rlike(V.FLASHES) & t.rlike(V.FLASHES), 12).otherwise(0)


def matches_term(text: Column, term: Column) -> Column:
    """A term occurs, or the first four letters of a term of at least four do."""
    return F.contains(text, term) | ((F.length(term) >= 4) & F.contains(text, F.substring(term, 1, 4)))


def matching_terms(terms: str | Column, text: Column) -> Column:
    return F.filter(col(terms), lambda t: matches_term(text, t))


def sentence_score(sentence: str | Column, terms: str | Column, primary: str | Column) -> Column:
    low = F.lower(col(sentence))
    score = F.size(matching_terms(terms, low)) * 2
    score += F.when(low.rlike(V.URGENT), 2).otherwise(0) + F.when(low.rlike(V.ACTION), 3).otherwise(0)
    score += F.when(F.contains(low, F.lit("immediately")), 2).otherwise(0)
    score += F.when(F.contains(low, F.lit("including")), -2).otherwise(0)
    return score + F.when(col(primary), 4).otherwise(0)


def is_usable_summary(c: str | Column) -> Column:
    t = strip(text_or_empty(c))
    low, words = F.lower(t), word_count(t)
    leaks = F.exists(F.array(*map(F.lit, V.LEAKAGE)), lambda x: F.contains(low, x))
    fits = (words >= V.SUMMARY_WORDS[0]) & (words <= V.SUMMARY_WORDS[1])
    return col(c).isNotNull() & (t != "") & ~low.rlike(V.REFUSAL) & ~leaks & fits & t.rlike(V.COMPLETE_SUMMARY)


def is_complete_sentence(c: str | Column) -> Column:
    return text_or_empty(c).rlike(r"[.!?][ \n\r\t]*\z")


def sentence_count(c: str | Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit("[.!?]"))


def sentence_case(c: str | Column) -> Column:
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.substring(col(c), F.lit(2), F.length(col(c))))


def speech_text(c: str | Column) -> Column:
    """Answer text for reading aloud: citations as 'Page N.', bullets as blanks."""
    t = F.regexp_replace(text_or_empty(c), V.CITATION, ". Page $1.")
    return one_line(F.replace(t, F.lit("•"), F.lit(" ")))


def transcript_case(c: str | Column) -> Column:
    t = one_line(text_or_empty(c))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))


def duration_text(nanos: str | Column) -> Column:
    n = col(nanos)
    return F.format_string("%.3f s (%.1f ms)", n / 1e9, n / 1e6)


def worker_threads(n: str | Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), col(n)) * 0.8).cast("int"))


def context_title(chapter: str | Column, topic: str | Column) -> Column:
    return F.when(text_or_empty(topic) != "", col(topic)).otherwise(text_or_empty(chapter))


def render_context(chapter: str | Column, topic: str | Column, qualifier: str | Column, body: str | Column) -> Column:
    """Headings of a chunk above its body."""
    c, t, q = text_or_empty(chapter), text_or_empty(topic), text_or_empty(qualifier)
    parts = F.array(
        F.when(c != "", F.concat(F.lit("## "), c)), F.when((t != "") & (t != c), F.concat(F.lit("### "), t)),
        F.when(q != "", F.concat(F.lit("#### "), q)), F.when(text_or_empty(body) != "", col(body)),
    )
    return F.array_join(F.array_compact(parts), "\n\n")


def prompt(question: str | Column, context: str | Column) -> Column:
    """One user turn of a chat prompt, the reply left open."""
    return F.format_string(V.PROMPT, col(question), col(context))
