"""Text cleaning, tokenising and counting as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions.wordlists import ENGLISH_STOPWORDS, REVIEW_STOPWORDS

# All Unicode blanks except the plain space; they become plain spaces first, so that the
# later patterns can use cheap single-character classes.
_BLANKS = r"[\x1c\x1d\x1e\x1f[\p{IsWhite_Space}&&[^ ]]]"
_URL = "(?:http|www)[^ ]+"
# A blank-delimited word is a mail address if an @ stands strictly inside it. The
# look-behind and the possessive run keep the scan linear on very long words.
_MAIL = "(?<![^ ])[^ ][^@ ]*+@[^ ]+"
_PHONE = r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
# Everything but letters, digits, blanks and . , ! ? -- written as the ranges between
# them, which the JVM tests several times faster than a negated class.
_UNWANTED = (
    r"[\x00-\x1f\x{22}-\x{2b}\x{2d}\x{2f}\x{3a}-\x{3e}\x{40}"
    r"\x{5b}-\x{60}\x{7b}-\x{10ffff}]+"
)

# Words the word tokenizer splits in two.
_CONTRACTIONS = (
    r"\b(?:(can)(not)|(gim)(me)|(gon)(na)|(got)(ta)|(lem)(me)|(wan)(na))\b"
)
_CONTRACTION_PARTS = " $1$3$5$7$9$11 $2$4$6$8$10$12 "


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once, however often it is used and in whatever loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _drop_if(text: Column, marks: tuple[str, ...], pattern: str) -> Column:
    """Remove a pattern from the few texts that hold a sign of it at all.

    The byte search for a fixed string is far cheaper than the pattern. Going through a
    one-element array names the text, so that it is worked out once and not per use.
    """

    def drop(t: Column) -> Column:
        suspect = reduce(or_, [F.contains(t, F.lit(m)) for m in marks])
        return F.when(suspect, F.regexp_replace(t, pattern, "")).otherwise(t)

    return F.get(F.transform(F.array(text), drop), F.lit(0))


def clean_text(text: Column) -> Column:
    """Lower-cased text without links, mail addresses, phone numbers and symbols."""
    out = F.regexp_replace(F.lower(text), _BLANKS, " ")
    out = _drop_if(out, ("http", "www"), _URL)
    out = _drop_if(out, ("@",), _MAIL)
    out = F.regexp_replace(out, _PHONE, "")
    out = F.regexp_replace(out, _UNWANTED, "")
    out = F.regexp_replace(out, " {2,}", " ")
    return F.coalesce(F.trim(out), F.lit(""))


def words(text: Column) -> Column:
    """Blank-separated words of a cleaned text; none for the empty text."""
    return F.filter(F.split(text, " "), lambda word: word != "")


def word_tokens(clean: Column) -> Column:
    """Word and punctuation tokens of a cleaned text."""
    out = F.regexp_replace(clean, r"\.{2,}|[!?]", " $0 ")
    out = F.regexp_replace(out, r",([^0-9]|$)", " , $1")
    out = F.regexp_replace(out, r"([^.])\.( |$)", "$1 . $2")
    out = F.regexp_replace(out, _CONTRACTIONS, _CONTRACTION_PARTS)
    return words(out)


def drop_stopwords(
    tokens: Column,
    stopwords: Iterable[str] = ENGLISH_STOPWORDS + REVIEW_STOPWORDS,
    min_length: int = 3,
) -> Column:
    """Tokens of at least ``min_length`` characters that are not stopwords."""
    listed = sorted(set(stopwords))
    return F.filter(
        tokens, lambda token: (F.length(token) >= min_length) & ~token.isin(listed)
    )


def _cut(token: Column, n: int) -> Column:
    return F.substring(token, F.lit(1), F.length(token) - n)


def singular(token: Column) -> Column:
    """Rule-based noun lemma: plural endings only, no dictionary."""

    def ends(*endings: str) -> Column:
        return reduce(or_, [F.endswith(token, F.lit(e)) for e in endings])

    return (
        F.when(~ends("s") | (F.length(token) <= 3), token)
        .when(ends("ss", "us", "is"), token)
        .when(ends("sses", "shes", "ches", "xes", "zes"), _cut(token, 2))
        .when(ends("ies"), F.concat(_cut(token, 3), F.lit("y")))
        .otherwise(_cut(token, 1))
    )


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def snippet(text: Column, length: int = 150) -> Column:
    """Report excerpt: the first ``length`` characters and three dots."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def keyword_list_label(keywords: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(keywords, 1, n), ", ")
