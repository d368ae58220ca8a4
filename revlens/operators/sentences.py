"""Sentence ends: which words carry a full stop of their own?

Abbreviations are learned from the texts at hand, without labels: a word that nearly always
stands before a full stop, is short and perhaps has stops inside is taken for one. Spark counts
the words; what reaches the driver is nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.text import named, word_tokens, words
from revlens.operators.joins import with_hits
from revlens.sources.sinks import stored

# Fixed values of the published method (Kiss & Strunk 2006).
STOP_LIKELIHOOD = 0.99
THRESHOLD = 0.3

_MARKS = ",!?"
#: Stands for the full stop of an abbreviation while a text is cut; cleaned texts never hold it.
_KEPT_STOP = "\x01"


def _ends_in_stop(word: Column) -> Column:
    """One full stop behind something else. No pattern: this is asked of every word."""
    stop = F.endswith(word, F.lit("."))
    return stop & ~F.endswith(word, F.lit("..")) & (F.length(word) > 1)


def stop_counts(df: DataFrame, text: str = "content_clean") -> DataFrame:
    """term, with_stop, without_stop: how often each word stands with and without a full stop.

    Words that end in several dots, and words of marks alone, are left out. Words are counted as
    they stand first, so that only distinct ones are shuffled and looked at.
    """
    standing = df.select(F.explode(F.split(F.lower(text), " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    word, n = F.col("word"), F.col("n")
    bare = standing.select(F.btrim("word", F.lit(_MARKS)).alias("word"), "n")
    stop = _ends_in_stop(word)
    return (
        bare.where((word != "") & (stop | ~F.endswith(word, F.lit("."))))
        .select(F.when(stop, F.rtrim(word, F.lit("."))).otherwise(word).alias("term"), stop.alias("stop"), "n")
        .groupBy("term")
        .agg(F.sum(F.when(F.col("stop"), n).otherwise(0)).alias("with_stop"), F.sum(F.when(~F.col("stop"), n).otherwise(0)).alias("without_stop"))
    )


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """Words seen with a full stop and with a letter, and how likely each is an abbreviation.

    The score compares two explanations of the stops behind a word by their likelihoods (a stop
    comes as often as behind any word, or nearly always), and is lowered for long words and for
    each time the word stood without one. The counts are written once, so that the texts behind
    them are read once.
    """
    counts = stored(counts, "word-counts")
    total = counts.agg(
        F.sum(F.col("with_stop") + F.col("without_stop")).alias("n_words"), F.sum("with_stop").alias("n_stops")
    )
    with_stop, without = F.col("with_stop"), F.col("without_stop")
    # all words at a stop: a word then says nothing about itself, and its rate stays below one
    rate = F.least(F.col("n_stops") / F.col("n_words"), F.lit(STOP_LIKELIHOOD))

    def log_likelihood(p: Column) -> Column:
        return with_stop * F.log(p) + without * F.log(1 - p)

    evidence = -2 * (log_likelihood(rate) - log_likelihood(F.lit(STOP_LIKELIHOOD)))
    inner = F.length("term") - F.length(F.replace("term", F.lit("."), F.lit("")))
    letters = F.length("term") - inner
    score = evidence * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -without.cast("double"))
    wanted = counts.where((with_stop > 0) & F.col("term").rlike("[a-z]"))
    # one row of totals
    return wanted.join(F.broadcast(total)).select("term", "with_stop", "without_stop", score.alias("score"))


def abbreviations(df: DataFrame, text: str = "content_clean", threshold: float = THRESHOLD) -> DataFrame:
    """term, without its last full stop, of the abbreviations of these texts."""
    return abbreviation_scores(stop_counts(df, text)).where(F.col("score") >= threshold).select("term")


def tokenize(
    df: DataFrame, abbreviations: DataFrame, text: str = "content_clean", key: str = "review_id", column: str = "tokens"
) -> DataFrame:
    """``df`` with the tokens of its cleaned text; an abbreviation keeps its full stop.

    At the very end of a text the stop is split off in any case. ``abbreviations`` has the column
    ``term``; ``key`` has to be unique. Null texts give null tokens.
    """
    listed = df.withColumn("__words", words(F.col(text)))
    inside = F.slice("__words", 1, F.greatest(F.size("__words") - 1, F.lit(0)))
    stopped = F.transform(F.filter(inside, _ends_in_stop), lambda w: F.rtrim(w, F.lit(".")))
    terms = abbreviations.select(F.lower("term").alias("term")).distinct()
    found = with_hits(listed, stopped, terms, "term", "__known", key)

    def mark(known: Column) -> Column:
        def kept(w: Column, i: Column) -> Column:
            short = F.rtrim(w, F.lit("."))
            stays = (i < F.size("__words") - 1) & _ends_in_stop(w) & F.array_contains(known, short)
            return F.when(stays, F.concat(short, F.lit(_KEPT_STOP))).otherwise(w)

        return F.array_join(F.transform("__words", kept), " ")

    known = F.transform("__known", lambda k: k["term"])
    marked = F.when(F.size("__known") > 0, named(known, mark)).otherwise(F.col(text))
    cut = F.transform(word_tokens(marked), lambda t: F.replace(t, F.lit(_KEPT_STOP), F.lit(".")))
    return found.withColumn(column, cut).drop("__known", "__words")
