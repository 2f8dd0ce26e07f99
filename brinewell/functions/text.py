"""Text functions of search: query terms, folding, tokens, snippets. Built-in expressions but for Unicode decomposition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"
#: Terms of a query, characters of a term.
MAX_TERMS, MAX_TERM = 16, 64


def fold_text(text: str, form: str = "NFD", keep_marks: bool = False) -> str:
    decomposed = unicodedata.normalize(form, text)
    return decomposed if keep_marks else "".join(c for c in decomposed if not unicodedata.category(c).startswith("M"))


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """Decomposed, without marks, lower case; null stays null. ASCII texts skip the decomposition."""
    return text.map(lambda t: t if t is None else t.lower() if t.isascii() else fold_text(t).lower())


@F.pandas_udf(T.StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Lower case in compatibility decomposition, marks kept."""
    return text.map(lambda t: t if t is None else t.lower() if t.isascii() else fold_text(t.lower(), "NFKD", True))


def all_tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def tokens(folded: Column) -> Column:
    """The set of letter and digit runs of folded text."""
    return F.array_distinct(all_tokens(folded))


def query_terms(raw: Column) -> Column:
    """The first 16 runs of letters and digits of the lower-cased query, each cut to 64 characters; repeats stay."""
    return F.transform(F.slice(all_tokens(F.lower(raw)), 1, MAX_TERMS), lambda t: F.substring(t, 1, MAX_TERM))


def squash(folded: Column) -> Column:
    """Runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    """Words of three characters or more of the decomposed text (marks separate, as they are neither letters nor digits)."""
    return F.array_distinct(F.filter(all_tokens(decomposed(text)), lambda w: F.char_length(w) >= 3))


def path_shares(path: Column, title_words: Column) -> Column:
    """Whether the path's words and the title's overlap."""
    return F.coalesce(F.arrays_overlap(words(decoded(path)), title_words), F.lit(False))


def decoded(text: Column) -> Column:
    """Percent-decoded, + untouched; malformed input stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)


SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def cleaned(text: Column) -> Column:
    """Control characters and runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "), SPACE + "+", " "))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: an expression that stands in several places would be computed in each."""
    return F.transform(F.array(value), use)[0]


def snippet(text: Column, description: Column, terms: Column) -> Column:
    """Some 220 characters of text from 70 before the first term on, cut at words; without a term the description's or text's start."""

    def around(body: Column, at: Column) -> Column:
        start = F.greatest(F.lit(0), at - 70)
        end = F.least(F.char_length(body), start + 220)
        window = F.substring(body, start + 1, end - start)
        window = F.when(start > 0, F.regexp_replace(window, r"^\S*\s", "")).otherwise(window)
        window = F.when(end < F.char_length(body), F.regexp_replace(window, r"\s\S*$", "")).otherwise(window)
        found = F.concat(F.when(start > 0, "… ").otherwise(""), window, F.when(end < F.char_length(body), " …").otherwise(""))
        lead = F.substring(cleaned(description), 1, 220)
        return F.when(at.isNotNull(), found).when(lead != "", lead).otherwise(F.substring(body, 1, 220))

    def first(body: Column) -> Column:
        return bound(F.lower(body), lambda low: F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t) - 1), lambda i: i >= 0)))

    return bound(cleaned(text), lambda body: bound(first(body), lambda at: around(body, at)))


def excerpt(text: Column, terms: Column, size: int = 24) -> Column:
    """`size` tokens of the body around the first matching token, for the plain search."""
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))
    hit = F.array_min(F.filter(F.transform(terms, lambda t: F.array_position(F.transform(parts, lambda p: F.lower(p)), t)), lambda i: i > 0))
    start = F.greatest(F.lit(1), F.coalesce(hit, F.lit(1)).cast("int") - size // 2)
    words_ = F.array_join(F.slice(parts, start, size), " ")
    return F.concat(F.when(start > 1, "…").otherwise(""), words_, F.when(F.size(parts) >= start + size, "…").otherwise(""))


def title_or_address(title: Column, host: Column, path: Column) -> Column:
    return F.when(F.trim(title) == "", F.concat(host, F.when(path == "/", "").otherwise(path))).otherwise(F.trim(title))


def query_key(salt: Column, folded_terms: Column) -> Column:
    """Salted key of a query, the same for any order of its terms."""
    joined = F.array_join(F.array_sort(F.array_distinct(folded_terms)), " ")
    return F.sha2(F.concat(salt, F.lit("\0"), joined), 256)
