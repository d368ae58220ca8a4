"""Sentiment from word lists.

A review is cut into words that carry their three predecessors with them. Each word is
looked up in the lexicon by a join the small side of which is broadcast, and the hits of
a review are summed where the review stands: map-side sums leave one row per review for
the only shuffle. No window over all words is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.labels import classify_compound, classify_polarity
from revlens.functions.text import named, words
from revlens.functions.wordlists import BOOSTERS_DOWN, BOOSTERS_UP, NEGATORS
from revlens.operators.joins import small_side, with_hits

# Fixed values of the published valence rules (Hutto & Gilbert 2014).
BOOST = 0.293
NEGATION = -0.74
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
NORMALIZER = 15.0

_PUNCTUATION = ".,!?"


def _bare_words(text: Column) -> Column:
    longer = F.filter(words(text), lambda w: F.length(w) > 1)
    return F.transform(longer, lambda w: F.btrim(w, F.lit(_PUNCTUATION)))


def _unique_terms(lexicon: DataFrame, *values: str) -> DataFrame:
    """One row per term, so that a repeated term cannot count twice.

    Entries of several words are cut as texts are; what is a single word then is no phrase, and
    is left out.
    """
    term = F.lower("term")
    phrase = F.contains(F.trim(term), F.lit(" "))
    parts = F.filter(_bare_words(term), lambda w: w != "")
    cut = F.when(phrase, F.when(F.size(parts) > 1, F.array_join(parts, " "))).otherwise(term)
    first = F.min(F.struct(*values)).alias("v")
    return lexicon.groupBy(cut.alias("term")).agg(first).where("term IS NOT NULL").select("term", "v.*")


def merge_phrases(df: DataFrame, phrases: DataFrame, column: str = "words", key: str = "review_id") -> DataFrame:
    """``df`` with phrases of its word list made single entries, the words joined by blanks.

    Phrases are taken from left to right, the longest first, and never overlap. They form a trie
    whose first two levels are a table: a row looks up its pairs of neighbours in one join and gets
    the branches below them, which are walked where the row stands. ``phrases`` has the column
    ``term`` (words joined by single blanks); ``key`` has to be unique.
    """
    words_of = F.col(column)
    longest = F.sort_array(F.collect_set(F.struct(F.size("parts").alias("n"), "parts")), asc=False)
    branches = (
        phrases.select(F.split("term", " ").alias("parts"))
        .where(F.size("parts") > 1)
        .groupBy(F.array_join(F.slice("parts", 1, 2), " ").alias("head"))
        .agg(longest.alias("below"))
    )

    def pair(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", w, F.get(words_of, i + 1))

    found = with_hits(df, F.transform(words_of, pair), branches, "head", "__branches", key)

    def phrases_at(known: Column) -> Column:
        def ending(w: Column, i: Column) -> Column:
            below = F.try_element_at(known, pair(w, i))
            fits = F.filter(below, lambda p: F.slice(words_of, i + 1, p["n"]) == p["parts"])
            return F.struct(i.alias("at"), F.coalesce(F.get(fits, F.lit(0))["n"], F.lit(0)).alias("n"))

        return F.filter(F.transform(words_of, ending), lambda p: p["n"] > 0)

    places = named(F.map_from_entries("__branches"), phrases_at)
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,n:int>>").alias("taken"))

    def take(state: Column, p: Column) -> Column:
        end = F.struct((p["at"] + p["n"]).alias("free"), F.array_append(state["taken"], p).alias("taken"))
        return F.when(p["at"] >= state["free"], end).otherwise(state)

    def merged(taken: Column) -> Column:
        def piece(p: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(taken, k - 1)["at"] + F.get(taken, k - 1)["n"], F.lit(0))
            phrase = F.array_join(F.slice(words_of, p["at"] + 1, p["n"]), " ")
            return F.concat(F.slice(words_of, begin + 1, p["at"] - begin), F.array(phrase))

        last = F.element_at(taken, -1)
        rest = F.slice(words_of, last["at"] + last["n"] + 1, F.size(words_of))
        return F.when(F.size(taken) > 0, F.concat(F.flatten(F.transform(taken, piece)), rest)).otherwise(words_of)

    changed = F.when(F.size("__branches") > 0, named(F.aggregate(places, start, take)["taken"], merged))
    return found.withColumn(column, changed.otherwise(words_of)).drop("__branches")


def _phrases_merged(split: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Word lists with the lexicon's phrases as single entries; a lexicon without any costs nothing."""
    phrases = terms.where(F.contains("term", F.lit(" "))).select("term")
    return split if phrases.isEmpty() else merge_phrases(split, phrases, key=key)


def _known(terms: DataFrame, candidates: Sequence[str]) -> set[str]:
    """Which of the few candidate words are in the lexicon? At most that many rows."""
    found = terms.where(F.col("term").isin(list(candidates))).select("term").collect()
    return {row.term for row in found}


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _punctuation_boost(text: Column) -> Column:
    exclamations = F.least(_count(text, "!"), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION
    questions = _count(text, "?")
    return exclamations + (
        F.when(questions <= 1, 0.0).when(questions <= 3, questions * QUESTION).otherwise(MANY_QUESTIONS)
    )


def _one_of(word: Column, listed: Sequence[str]) -> Column:
    return word.isin(list(listed)) if listed else F.lit(False)


def _valence(
    base: Column, before: Column, up: Sequence[str], down: Sequence[str], negators: Sequence[str], known: set[str]
) -> Column:
    """Valence of a hit after its predecessors (nearest first) had their say."""

    def step(value: Column, item: Column) -> Column:
        word, next_word, nearest = item["word"], item["next"], item["nearest"]
        amount = (
            F.when(_one_of(word, [w for w in up if w not in known]), BOOST)
            .when(_one_of(word, [w for w in down if w not in known]), -BOOST)
            .otherwise(0.0)
        )
        boosted = value + F.signum(value) * amount * item["damping"]
        # "never so ..." and "never this ..." strengthen instead of negating
        emphatic = (word == "never") & (next_word.isin("so", "this") | nearest.isin("so", "this"))
        factor = (
            F.when(emphatic & (item["distance"] == 2), 1.5)
            .when(emphatic & (item["distance"] == 3), 1.25)
            .when(_one_of(word, [w for w in negators if w not in known]), NEGATION)
            .otherwise(1.0)
        )
        return boosted * factor

    def word_at(i: int) -> Column:
        return F.coalesce(F.get(before, F.lit(i)), F.lit(""))

    items = F.array(
        *[
            F.struct(
                word_at(i).alias("word"),
                word_at(max(i - 1, 0)).alias("next"),
                word_at(0).alias("nearest"),
                F.lit(DISTANCE_DAMPING[i]).alias("damping"),
                F.lit(i + 1).alias("distance"),
            )
            for i in range(3)
        ]
    )
    value = F.aggregate(items, base.cast("double"), step)
    least = (
        (word_at(0) == "least") & ~word_at(1).isin("at", "very")
        if "least" not in known
        else F.lit(False)
    )
    return value * F.when(least, NEGATION).otherwise(1.0)


def lexicon_compound(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "content_clean",
    key: str = "review_id",
    keep: Sequence[str] = (),
    negators: Sequence[str] = NEGATORS,
    boosters_up: Sequence[str] = BOOSTERS_UP,
    boosters_down: Sequence[str] = BOOSTERS_DOWN,
) -> DataFrame:
    """Compound valence in [-1, 1] and its class for every review; 0 without any hit.

    ``lexicon`` is (term, polarity); a term of several words counts as one word where it occurs,
    and its words do not count for themselves. ``key`` has to be unique; ``keep`` names further
    columns of the review to carry along.
    """
    boosters = [*boosters_up, *boosters_down]
    terms = _unique_terms(lexicon, "polarity")
    known = _known(terms, [*negators, *boosters, "least"])
    terms = terms.where(~_one_of(F.col("term"), boosters))

    carried = [key, *keep]
    split = df.select(*carried, F.col(text).alias("text"), _bare_words(F.col(text)).alias("words"))
    split = _phrases_merged(split, terms, key)
    tokens = F.transform(
        "words",
        lambda word, i: F.struct(
            word.alias("term"),
            i.alias("position"),
            # single look-ups: slicing would copy the whole review for every word
            F.array(*[F.get("words", i - back) for back in (1, 2, 3)]).alias("before"),
        ),
    )
    # the explode below copies every other column once per word, so the text and the
    # word list have to be gone by then
    exploded = split.select(
        *carried,
        F.array_position("words", F.lit("but")).alias("but_at"),
        _punctuation_boost(F.col("text")).alias("punctuation"),
        tokens.alias("tokens"),
    ).select(*carried, "but_at", "punctuation", F.explode_outer("tokens").alias("t"))
    exploded = exploded.select(*carried, "but_at", "punctuation", "t.*")
    valence = _valence(F.col("polarity"), F.col("before"), boosters_up, boosters_down, negators, known)
    place = F.col("position") + 1
    weight = (
        F.when((F.col("but_at") == 0) | (place == F.col("but_at")), 1.0)
        .when(place < F.col("but_at"), BEFORE_BUT)
        .otherwise(AFTER_BUT)
    )
    hit = F.when(F.col("polarity").isNotNull(), valence * weight)
    summed = (
        exploded.join(small_side(terms), "term", "left")
        .groupBy(*carried)
        .agg(F.coalesce(F.sum(hit), F.lit(0.0)).alias("s"), F.max("punctuation").alias("p"))
        .withColumn("s", F.col("s") + F.signum("s") * F.col("p"))
    )
    compound = F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + NORMALIZER), 4)
    return summed.select(*carried, compound.alias("vader_compound")).withColumn(
        "vader_sentiment", classify_compound(F.col("vader_compound"))
    )


def lexicon_polarity(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "content_clean",
    key: str = "review_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Mean polarity and subjectivity of the words found, 0 without any, and the class."""
    carried = [key, *keep]
    terms = _unique_terms(lexicon, "polarity", "subjectivity")
    split = _phrases_merged(df.select(*carried, _bare_words(F.col(text)).alias("words")), terms, key)
    exploded = split.select(*carried, F.explode_outer("words").alias("term"))
    return (
        exploded.join(small_side(terms), "term", "left")
        .groupBy(*carried)
        .agg(
            # rounding makes the mean, and the class at a threshold, independent of the
            # order in which words are added up
            F.round(F.coalesce(F.avg("polarity"), F.lit(0.0)), 10).alias("textblob_polarity"),
            F.round(F.coalesce(F.avg("subjectivity"), F.lit(0.0)), 10).alias("textblob_subjectivity"),
        )
        .withColumn("textblob_sentiment", classify_polarity(F.col("textblob_polarity")))
    )


def lemmatize(
    df: DataFrame,
    dictionary: DataFrame,
    tokens: str = "tokens_nostop",
    key: str = "review_id",
    column: str = "content_lemmatized",
) -> DataFrame:
    """Replace word forms by the lemmas of a (form, lemma) table; other words stay.

    Only the lemmas a review really uses come to it, as one short map, and its words are
    replaced in place. ``key`` has to be unique.
    """
    forms = dictionary.where(F.col("form") != F.col("lemma")).groupBy("form").agg(F.min("lemma").alias("lemma"))
    found = with_hits(df, F.col(tokens), forms, "form", "__lemmas", key)

    def replaced(known: Column) -> Column:
        return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t))

    lemmas = F.when(F.size("__lemmas") > 0, named(F.map_from_entries("__lemmas"), replaced)).otherwise(F.col(tokens))
    return found.withColumn(column, F.array_join(lemmas, " ")).drop("__lemmas")
