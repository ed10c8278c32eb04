"""Names and texts as tokens, and how alike two names are."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as V


def _strings(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))


def split_name(name: Column) -> Column:
    """Lower-case parts of a name, cut at camel-case boundaries and at whatever is not a letter or digit of ASCII."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z]*[a-z0-9]+|[A-Z]+"), F.lit(0)), F.lower)


def tokenize(name: Column) -> Column:
    """``split_name`` with abbreviations spelled out."""
    known = F.create_map(*(x for k, v in V.ABBREVIATIONS.items() for x in (F.lit(k), _strings(v.split()))))
    return F.flatten(F.transform(split_name(name), lambda x: F.coalesce(known[x], F.array(x))))


def without_stop_words(tokens: Column) -> Column:
    """Tokens that carry meaning; all of them where none does."""
    kept = F.filter(tokens, lambda x: ~x.isin(*V.STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def synonyms(tokens: Column, groups: Sequence[Sequence[str]] = V.SEARCH_GROUPS) -> Column:
    """Words of every group that a token is in, without the tokens themselves."""
    own = [F.when(F.arrays_overlap(tokens, _strings(g)), _strings(g)).otherwise(F.array().cast("array<string>")) for g in groups]
    return F.array_except(F.concat(*own), tokens)


def expand(tokens: Column, groups: Sequence[Sequence[str]] = V.NAME_GROUPS) -> Column:
    return F.array_union(tokens, synonyms(tokens, groups))


def canonical_id(name: Column) -> Column:
    """One id for names that mean the same attribute: a group of synonyms, or the sorted distinct tokens."""
    tokens = tokenize(name)
    groups = [F.when(F.arrays_overlap(tokens, _strings(g)), F.lit("|".join(sorted(g)))) for g in V.NAME_GROUPS]
    return F.coalesce(*groups, F.array_join(F.array_sort(F.array_distinct(tokens)), " "))


def shares_group(a: Column, b: Column) -> Column:
    x, y = tokenize(a), tokenize(b)
    out = F.lit(False)
    for g in V.NAME_GROUPS:
        out |= F.arrays_overlap(x, _strings(g)) & F.arrays_overlap(y, _strings(g))
    return out


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, for which there is no built-in function."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """1 where both names touch one group of synonyms, else the ratio of the lower-case names."""
    return F.when(shares_group(a, b), 1.0).otherwise(ratio(F.lower(a), F.lower(b)))


def is_vacuous(name: Column, description: Column) -> Column:
    """A name or description that says nothing."""
    low, text = F.lower(name), F.coalesce(description, F.lit(""))
    return low.isin(*V.VACUOUS_NAMES) | text.rlike(V.VACUOUS_TEXT) | ((text == "") & low.isin(*V.PLACEHOLDER_NAMES))


def implies_quantity(name: Column, datatype: Column) -> Column:
    """A string attribute whose name has a quantity word as a whole token."""
    return (datatype == "string") & F.arrays_overlap(split_name(name), _strings(V.QUANTITY_WORDS))


def is_sentinel(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(*V.SENTINELS)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column, clamp: bool = True) -> Column:
    """Of two vectors; 0 for empty vectors, other lengths and zero norms. Clamped below at 0 by default."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)
    return F.greatest(F.lit(0.0), value) if clamp else value


def datatype_fit(column: Column, freetext: Column, concept: Column) -> Column:
    """How well a column of one datatype fits a concept of another; the first row that holds counts."""
    plain = ("integer", "number", "boolean")
    both = lambda *pair: column.isin(*pair) & concept.isin(*pair)
    return (
        F.when(concept.isNull(), 0.15)
        .when(column == concept, 1.0)
        .when(both("integer", "number") | both("date", "datetime"), 0.6)
        .when(column.isin(*plain) & (concept == "string"), 0.0)
        .when((column == "string") & concept.isin(*plain), F.when(freetext, 0.0).otherwise(0.15))
        .when((column == "string") | (concept == "string"), 0.15)
        .otherwise(0.0)
    )


def shape_fit(shape: Column, name: Column, datatype: Column) -> Column:
    """1 where a column's shape fits the concept's name or datatype."""
    low = F.lower(name)
    web = low.contains("url") | low.contains("website") | low.contains("homepage") | low.contains("site")
    fits = ((shape == "url") & web) | ((shape == "email") & low.contains("email")) | ((shape == "iso_datetime") & datatype.isin("date", "datetime"))
    return F.when(F.coalesce(fits, F.lit(False)), 1.0).otherwise(0.0)
