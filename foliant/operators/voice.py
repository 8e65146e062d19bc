"""Repair of spoken questions: known homophones in context, then unambiguous near words of the domain."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import fixed_values as V
from foliant.functions.udfs import osa_distance

_WORD = re.compile(r"[a-z']+")
_DOMAIN, _NEVER = frozenset(V.DOMAIN_WORDS), frozenset(V.NEVER_FUZZY)


@functools.lru_cache(100_000)
def nearest_term(word: str, in_domain: bool) -> str:
    """The one term of the vocabulary within the edit limit, or the word itself."""
    if len(word) < 4 or word in _DOMAIN or word in _NEVER:
        return word
    limit = 1 + (len(word) >= 7)
    scored = []
    for term in V.FUZZY_TERMS:
        edits = osa_distance(word, term, limit)
        scored.append((2 * edits + (word.endswith("s") != term.endswith("s")), edits, term))
    best = min(s for s, _, _ in scored)
    winners = [(edits, term) for s, edits, term in scored if s == best]
    edits, term = winners[0]
    if len(winners) > 1 or edits > limit or (edits == 2 and not in_domain):
        return word
    return term


def normalize(said: str | None) -> str:
    text = re.sub(r"\s+", " ", said or "", flags=re.ASCII).strip().lower()
    words = set(_WORD.findall(text))
    if words & set(V.QUESTION_CUES) or words & _DOMAIN:
        context = {"year": words & set(V.YEAR_CONTEXT), "car": words & set(V.CAR_CONTEXT)}
        for heard, meant in V.PHONETIC_FIXES.items():
            if context[meant]:
                text = re.sub(rf"\b{heard}\b", meant, text, flags=re.ASCII)
        for heard, meant in V.JOINED_FIXES.items():
            text = re.sub(heard, meant, text, flags=re.ASCII)
        in_domain = bool(set(_WORD.findall(text)) & _DOMAIN)
        text = _WORD.sub(lambda m: nearest_term(m.group(), in_domain), text)
        text = re.sub(r"\s+", " ", text, flags=re.ASCII).strip()
    return text[:1].upper() + text[1:]


@F.pandas_udf(T.StringType())
def _normalized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for said in batches:
        yield said.map(normalize)


def normalized_transcript(c: Column) -> Column:
    return _normalized(c)


def choose_offline_voice(voices: DataFrame) -> DataFrame:
    """Of (name, language, country, network) the voice to read with: English and offline, US first, then by name."""
    able = voices.where(~F.col("network") & (F.lower("language") == "en"))
    return able.agg(F.min_by(F.struct("name", "country"), F.struct(F.col("country") != "US", "name")).alias("v")).select("v.*")


def is_visible(c: Column) -> Column:
    """Whether partial output has a letter to show."""
    return F.coalesce(c, F.lit("")).rlike(r"\p{L}")
