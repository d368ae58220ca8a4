"""The queries of the catalog in SQL for DuckDB, written independently of the Spark code.

A query whose result depends on random starts or iteration has no entry here; the unit
tests check it against planted structure or brute force instead.
"""

from __future__ import annotations

from catalog.queries import LEMMAS, LEXICON, MANY_TOPICS, PHRASES, TOPICS
from revlens.functions.wordlists import (
    COMPACT_TAXONOMY,
    ENGLISH_STOPWORDS,
    FREQUENCY_STOPWORDS,
    ISSUE_TAXONOMY,
    REVIEW_STOPWORDS,
)


def _q(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_q(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _keywords(table: dict) -> str:
    rows = [(i, c, k) for i, (c, ks) in enumerate(table.items()) for k in ks]
    return _values("kw", "ordinal, category, keyword", rows)


# ------------------------------------------------------------------ shared steps

REVIEWS = """
base AS (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id * 17 % 17520 AS BIGINT)) AS review_ts
  FROM documents
),
reviews AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS review_id, text AS content,
    CAST(1 + (doc_id * 7 + n_chars) % 5 AS INT) AS score, review_ts,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'beta'
         ELSE CAST(1 + doc_id % 4 AS VARCHAR) || '.' || substr(source, 4) END AS app_version,
    CASE WHEN doc_id % 3 = 0 THEN 'Thanks' END AS reply_content,
    CASE WHEN doc_id % 3 = 0 THEN review_ts + to_hours(CAST(doc_id % 61 * 26 - 24 AS BIGINT)) END AS replied_at,
    lang, source
  FROM base
)"""

FACTS = (
    REVIEWS
    + """,
facts AS (
  SELECT *, year(review_ts) AS year, month(review_ts) AS month, quarter(review_ts) AS quarter,
    dayname(review_ts) AS day_of_week, CAST(review_ts AS DATE) AS review_date,
    strftime(review_ts, '%Y-%m') AS ym,
    CAST(reply_content IS NOT NULL AS INT) AS has_reply,
    CAST(app_version IS NOT NULL AS INT) AS has_version,
    date_diff('second', review_ts, replied_at) / 3600.0 AS response_time_hours,
    CASE WHEN regexp_extract(app_version, '^([0-9]+)', 1) <> ''
         THEN 'v' || regexp_extract(app_version, '^([0-9]+)', 1) ELSE 'Unknown' END AS major_version,
    CASE WHEN score >= 4 THEN 'Positive' WHEN score = 3 THEN 'Neutral' ELSE 'Negative' END AS sentiment_label
  FROM reviews
)"""
)

# The five patterns of the cleaning steps.
CLEAN = (
    FACTS
    + r""",
clean AS (
  SELECT *, coalesce(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      lower(content), 'http\S+|www\S+|https\S+', '', 'g'), '\S+@\S+', '', 'g'),
      '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b', '', 'g'), '[^a-zA-Z0-9\s.,!?]', '', 'g'), '\s+', ' ', 'g')), '')
      AS content_clean
  FROM facts
)"""
)

_SPLIT_WORDS = ""
for _first, _second in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")):
    _SPLIT_WORDS += rf", '\b({_first})({_second})\b', ' \1 \2 ', 'g')"

TOKENS = (
    CLEAN
    + r""",
tokens AS (
  SELECT *, list_filter(string_split("""
    + "regexp_replace(" * 9
    + r"""content_clean, '\.{2,}|[!?]', ' \0 ', 'g'),
      ',([^0-9]|$)', ' , \1', 'g'), '([^.])\.( |$)', '\1 . \2', 'g')"""
    + _SPLIT_WORDS
    + """, ' '), lambda t: t <> '') AS tokens
  FROM clean
)"""
)

NOSTOP = (
    TOKENS
    + f""",
nostop AS (
  SELECT *, array_to_string(kept, ' ') AS content_clean_nostop FROM (
    SELECT *, list_filter(tokens, lambda t: length(t) > 2 AND NOT list_contains(
      {_list(ENGLISH_STOPWORDS + REVIEW_STOPWORDS)}, t)) AS kept
    FROM tokens)
)"""
)

LEMMA = (
    NOSTOP
    + r""",
lemma AS (
  SELECT *, array_to_string(list_transform(kept, lambda t:
    CASE WHEN length(t) <= 3 OR regexp_matches(t, '(ss|us|is)$') OR NOT t LIKE '%s' THEN t
         WHEN regexp_matches(t, '(ss|sh|ch|x|z)es$') THEN substr(t, 1, length(t) - 2)
         WHEN t LIKE '%ies' THEN substr(t, 1, length(t) - 3) || 'y'
         ELSE substr(t, 1, length(t) - 1) END), ' ') AS content_lemmatized
  FROM nostop
)"""
)

PREDICTIONS = (
    FACTS
    + """,
predictions AS (
  SELECT *,
    ['Negative', 'Neutral', 'Positive'][1 + doc_id % 3] AS vader_sentiment,
    ['Negative', 'Neutral', 'Positive'][1 + (doc_id * 2 + 1) % 3] AS textblob_sentiment,
    CASE WHEN doc_id % 7 = 0 THEN 'Not Processed'
         ELSE ['Negative', 'Neutral', 'Positive'][1 + doc_id * 4 % 3] END AS roberta_sentiment,
    CASE WHEN doc_id % 5 <> 0 THEN ['Negative', 'Neutral', 'Positive'][1 + (doc_id * 5 + 2) % 3] END AS bert_sentiment,
    doc_id % 100 / 100.0 AS roberta_confidence,
    ['Negative', 'Neutral', 'Positive'][1 + doc_id % 4 % 3] AS prediction
  FROM facts
)"""
)

LAST_YEAR = """,
recent AS (
  SELECT * FROM {source}
  WHERE review_date >= (SELECT CAST(max(review_date) - INTERVAL 1 YEAR AS DATE) FROM {source})
)"""

CLASSES = ("Negative", "Neutral", "Positive")
COUNTS = ", ".join(f"count(*) FILTER (sentiment_label = '{c}') AS \"{c}\"" for c in CLASSES)
SHARES = ", ".join(
    f"round(count(*) FILTER (sentiment_label = '{c}') * 100.0 / count(*), 4) AS \"{c}\"" for c in CLASSES
)
BAND = "CASE WHEN {0} < 3 THEN 'critical' WHEN {0} < 4 THEN 'warning' ELSE 'good' END"

ORACLE: dict[str, str] = {}


def sql(name: str, steps: str, body: str) -> None:
    ORACLE[name] = f"WITH {steps.strip()}\n{body.strip()}"


# ------------------------------------------------------------------ sources, profile

sql(
    "reviews_view",
    REVIEWS,
    """SELECT doc_id, review_id, content, score, strftime(review_ts, '%Y-%m-%d %H:%M:%S') AS review_ts, app_version,
  reply_content, strftime(replied_at, '%Y-%m-%d %H:%M:%S') AS replied_at, lang, source FROM reviews""",
)
sql(
    "table_shape",
    REVIEWS,
    """SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns,
  'doc_id, review_id, content, score, review_ts, app_version, reply_content, replied_at, lang, source' AS columns,
  'bigint, string, string, int, timestamp_ntz, string, string, timestamp_ntz, string, string' AS types
FROM reviews""",
)
sql(
    "first_rows",
    REVIEWS,
    """SELECT doc_id, content, score, lang, CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS place
FROM reviews ORDER BY doc_id LIMIT 3""",
)


def _describe(source: str, columns) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 4) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max
FROM {source}"""
        for c in columns
    )


sql("describe_numeric", FACTS, _describe("facts", ["score", "response_time_hours", "has_reply"]))
ORACLE["describe_events"] = _describe("events", ["user_id", "value"])
sql(
    "missing_values",
    REVIEWS,
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS missing_count, "
        f"round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 4) AS missing_pct FROM reviews"
        for c in (
            "doc_id review_id content score review_ts app_version reply_content replied_at lang source".split()
        )
    )
    + ") WHERE missing_count > 0",
)

# ------------------------------------------------------------------ projections

sql(
    "parse_timestamps",
    REVIEWS,
    """SELECT doc_id, strftime(try_strptime(
  CASE WHEN doc_id % 17 = 0 THEN 'n/a' WHEN doc_id % 7 = 0 THEN '13/45/2024 99:99'
       ELSE strftime(review_ts, '%-m/%-d/%Y %-H:%M') END, '%m/%d/%Y %H:%M'), '%Y-%m-%d %H:%M:%S') AS review_ts
FROM reviews""",
)
sql(
    "temporal_features",
    FACTS,
    """SELECT doc_id, CAST(year AS INT) AS year, CAST(month AS INT) AS month, CAST(quarter AS INT) AS quarter,
  day_of_week, CAST(review_date AS VARCHAR) AS review_date FROM facts""",
)
sql("presence_flags", FACTS, "SELECT doc_id, has_reply, has_version FROM facts")
sql(
    "response_time",
    FACTS,
    "SELECT doc_id, round(response_time_hours, 4) AS hours, round(response_time_hours / 24, 4) AS days FROM facts",
)
sql("clean_text", CLEAN, "SELECT doc_id, content_clean FROM clean")
sql(
    "tokenize_review",
    TOKENS,
    "SELECT doc_id, CAST(len(tokens) AS INT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM tokens",
)
_ABBREVIATIONS = (
    TOKENS
    + r""",
cut AS (SELECT doc_id, list_filter(string_split(content_clean, ' '), lambda w: w <> '') AS words, content_clean FROM clean),
w AS (SELECT trim(u, ',!?') AS w FROM (SELECT unnest(words) AS u FROM cut)),
counts AS (SELECT regexp_replace(w, '\.$', '') AS term, sum(CAST(w LIKE '%.' AS INT)) AS a,
  sum(CAST(w NOT LIKE '%.' AS INT)) AS b FROM w WHERE w <> '' AND (w NOT LIKE '%.' OR regexp_matches(w, '[^.]\.$')) GROUP BY 1),
total AS (SELECT least(sum(a) / sum(a + b), 0.99) AS p FROM counts),
scores AS (SELECT term, a, b, length(replace(term, '.', '')) AS m, length(term) - m + 1 AS k,
  -2 * (a * ln(p) + b * ln(1 - p) - a * ln(0.99) - b * ln(0.01)) * exp(-m) * k * pow(CAST(m AS DOUBLE), -b) AS score
  FROM counts, total WHERE a > 0 AND regexp_matches(term, '[a-z]'))"""
)
sql(
    "abbreviation_scores",
    _ABBREVIATIONS,
    """SELECT term, CAST(a AS BIGINT) AS with_stop, CAST(b AS BIGINT) AS without_stop,
  round(score * 1000, 4) / 1000 AS score FROM scores""",
)
sql(
    "tokenize_abbreviations",
    _ABBREVIATIONS
    + r""",
marked AS (SELECT doc_id, array_to_string(list_transform(words, lambda w, i: CASE WHEN i < len(words)
    AND regexp_matches(w, '[^.]\.$') AND list_contains(known,
    regexp_replace(w, '\.$', '')) THEN regexp_replace(w, '\.$', '') || '#' ELSE w END), ' ') AS marked
  FROM cut, (SELECT list(term) AS known FROM scores WHERE score >= 1e-3)),
kept AS (SELECT doc_id, list_transform(list_filter(string_split("""
    + "regexp_replace(" * 9
    + r"""marked, '\.{2,}|[!?]', ' \0 ', 'g'),
      ',([^0-9]|$)', ' , \1', 'g'), '([^.])\.( |$)', '\1 . \2', 'g')"""
    + _SPLIT_WORDS
    + """, ' '), lambda t: t <> ''), lambda t: replace(t, '#', '.')) AS kept FROM marked)""",
    "SELECT doc_id, CAST(len(kept) AS INT) AS n_tokens, array_to_string(kept, ' ') AS tokens FROM kept",
)
sql("remove_stopwords", NOSTOP, "SELECT doc_id, content_clean_nostop FROM nostop")
sql("lemmatize", LEMMA, "SELECT doc_id, content_lemmatized FROM lemma")
sql(
    "lemmatize_dictionary",
    NOSTOP + ",\n" + _values("dict", "form, lemma", LEMMAS),
    """SELECT n.doc_id, coalesce(string_agg(coalesce(d.lemma, u.t), ' ' ORDER BY u.pos), '') AS content_lemmatized
FROM nostop n
LEFT JOIN (SELECT doc_id, unnest(kept) AS t, generate_subscripts(kept, 1) AS pos FROM nostop) u ON u.doc_id = n.doc_id
LEFT JOIN dict d ON d.form = u.t
GROUP BY n.doc_id""",
)
sql(
    "text_metrics",
    NOSTOP,
    """SELECT doc_id, CAST(length(content_clean) AS INT) AS review_length,
  CAST(len(list_filter(string_split(content_clean, ' '), lambda w: w <> '')) AS INT) AS word_count,
  CAST(len(kept) AS INT) AS word_count_nostop FROM nostop""",
)
sql("major_version", FACTS, "SELECT doc_id, app_version, major_version FROM facts")
sql("sentiment_label", FACTS, "SELECT doc_id, score, sentiment_label FROM facts")
sql(
    "normalize_label",
    REVIEWS,
    """SELECT doc_id, raw, CASE WHEN raw IN ('positive', 'POSITIVE') THEN 'Positive'
  WHEN raw IN ('negative', 'NEGATIVE') THEN 'Negative' ELSE 'Neutral' END AS label
FROM (SELECT doc_id, ['positive', 'NEGATIVE', 'neutral', 'LABEL_1', 'POSITIVE', 'negative', 'NEUTRAL', 'Positive'][
  1 + doc_id % 8] AS raw FROM reviews)""",
)
sql(
    "encode_label",
    FACTS,
    """SELECT doc_id, CASE sentiment_label WHEN 'Negative' THEN 0 WHEN 'Neutral' THEN 1 ELSE 2 END AS code,
  sentiment_label AS decoded FROM facts""",
)
sql("rating_band", FACTS, f"SELECT doc_id, {BAND.format('score')} AS band FROM facts")

# ------------------------------------------------------------------ filters, sampling

sql(
    "has_text",
    CLEAN,
    "SELECT doc_id, CAST(length(content_clean) AS INT) AS n FROM clean WHERE content_clean <> ''",
)
sql("filter_sentiment", FACTS, "SELECT doc_id, score FROM facts WHERE score <= 2")
_HITS = " + ".join(f"CAST(contains(content_clean, '{w}') AS INT)" for w in ("the", "tion", "that", "que", "idiot"))
sql(
    "contains_keywords",
    CLEAN,
    f"""SELECT doc_id, CAST({_HITS} >= 1 AS INT) AS any_hit, CAST({_HITS} >= 3 AS INT) AS three_hits,
  CAST(len(list_filter(string_split(regexp_replace(content_clean, '[.,!?\\s]+', ' ', 'g'), ' '),
    lambda w: w IN ('the', 'tion', 'that', 'que', 'idiot'))) > 0 AS INT) AS token_hit FROM clean""",
)
sql(
    "last_year",
    FACTS + LAST_YEAR.format(source="facts"),
    "SELECT doc_id, CAST(review_date AS VARCHAR) AS review_date FROM recent",
)
OUTLIERS = """,
days AS (SELECT *, response_time_hours / 24 AS d FROM facts WHERE has_reply = 1 AND response_time_hours / 24 < 42)"""
sql("response_outliers", FACTS + OUTLIERS, "SELECT doc_id, round(d, 4) AS days FROM days")
sql(
    "valid_predictions",
    PREDICTIONS,
    """SELECT doc_id, roberta_sentiment FROM predictions
WHERE roberta_sentiment IS NOT NULL AND roberta_sentiment NOT IN ('Not Processed', 'Not Available')""",
)
sql(
    "seeded_sample",
    FACTS,
    "SELECT doc_id, sentiment_label FROM facts ORDER BY md5(review_id || ':42'), review_id LIMIT 100",
)

# ------------------------------------------------------------------ joins

sql(
    "merge_predictions",
    PREDICTIONS
    + """,
scored AS (
  SELECT review_id, roberta_sentiment AS l, roberta_confidence AS c FROM predictions WHERE doc_id % 4 <> 0
  UNION ALL
  SELECT review_id, bert_sentiment, 0.5 FROM predictions
  WHERE doc_id % 4 <> 0 AND doc_id % 6 = 1 AND bert_sentiment IS NOT NULL
),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY l, c) = 1)""",
    """SELECT f.doc_id, coalesce(o.l, 'Not Processed') AS roberta_sentiment,
  round(CAST(coalesce(o.c, 0) AS DOUBLE), 4) AS confidence
FROM facts f LEFT JOIN one o USING (review_id)""",
)
TOP8 = """(SELECT app_version FROM {source} WHERE app_version IS NOT NULL
  GROUP BY app_version ORDER BY count(*) DESC, app_version LIMIT 8)"""
sql(
    "top_version_rows",
    FACTS,
    f"SELECT doc_id, app_version FROM facts WHERE app_version IN {TOP8.format(source='facts')}",
)
sql(
    "taxonomy_match",
    NOSTOP + ",\n" + _keywords(ISSUE_TAXONOMY),
    "SELECT DISTINCT doc_id, category FROM nostop JOIN kw ON contains(content_clean_nostop, keyword)",
)

sql(
    "taxonomy_match_table",
    CLEAN
    + """,
kw AS (SELECT DISTINCT CAST(item_id % 10 AS INT) AS category, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS keyword
  FROM benchmark)""",
    "SELECT DISTINCT doc_id, category FROM clean JOIN kw ON contains(content_clean, keyword)",
)

# ------------------------------------------------------------------ reports

sql("score_distribution", FACTS, "SELECT score, count(*) AS n FROM facts GROUP BY score")
sql("sentiment_distribution", FACTS, "SELECT sentiment_label, count(*) AS n FROM facts GROUP BY 1")
_TOP = """SELECT app_version, count(*) AS n FROM {0} WHERE app_version IS NOT NULL
GROUP BY 1 ORDER BY n DESC, app_version LIMIT {1}"""
sql("top_versions", FACTS, _TOP.format("facts", 10))
sql("recent_top_versions", FACTS + LAST_YEAR.format(source="facts"), _TOP.format("recent", 5))
sql("reply_counts", FACTS, "SELECT has_reply, count(*) AS n FROM facts GROUP BY 1")
ORACLE["event_type_counts"] = "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1"
ORACLE["event_daily_volume"] = (
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1"
)
sql("monthly_volume", FACTS, "SELECT ym AS month, count(*) AS reviews FROM facts GROUP BY 1")
sql(
    "peak_months",
    FACTS + ",\nm AS (SELECT ym, count(*) AS n FROM facts GROUP BY 1)",
    """SELECT (SELECT ym FROM m ORDER BY n DESC, ym LIMIT 1) AS peak_month, (SELECT max(n) FROM m) AS peak_reviews,
  (SELECT ym FROM m ORDER BY n, ym LIMIT 1) AS lowest_month, (SELECT min(n) FROM m) AS lowest_reviews""",
)
sql("monthly_avg_rating", FACTS, "SELECT ym AS month, round(avg(score), 4) AS avg_rating FROM facts GROUP BY 1")
sql("monthly_sentiment", FACTS, f"SELECT ym AS month, {COUNTS} FROM facts GROUP BY 1")
sql("monthly_sentiment_pct", FACTS, f"SELECT ym AS month, {SHARES} FROM facts GROUP BY 1")
sql("recent_sentiment", FACTS, f"SELECT ym AS month, {COUNTS} FROM facts GROUP BY 1 ORDER BY 1 DESC LIMIT 6")
sql("daily_volume", FACTS, "SELECT CAST(review_date AS VARCHAR) AS review_date, count(*) AS n FROM facts GROUP BY 1")
sql(
    "daily_sentiment",
    FACTS,
    "SELECT CAST(review_date AS VARCHAR) AS review_date, sentiment_label, count(*) AS n FROM facts GROUP BY 1, 2",
)
sql(
    "weekday_sentiment",
    FACTS
    + ",\n"
    + _values(
        "week",
        "day_number, day_of_week",
        enumerate("Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(), start=1),
    )
    + f",\nd AS (SELECT day_of_week, {COUNTS} FROM facts GROUP BY 1)",
    """SELECT day_of_week, CAST(day_number AS INT) AS day_number, "Negative", "Neutral", "Positive"
FROM week LEFT JOIN d USING (day_of_week)""",
)
sql("score_by_sentiment", FACTS, "SELECT sentiment_label, score, count(*) AS n FROM facts GROUP BY 1, 2")
sql(
    "rating_summary",
    NOSTOP
    + """,
m AS (SELECT *, len(list_filter(string_split(content_clean, ' '), lambda w: w <> '')) AS w, len(kept) AS k,
  length(content_clean) AS chars FROM nostop)""",
    """SELECT count(*) AS reviews, round(avg(score), 4) AS mean_score, round(median(score), 4) AS median_score,
  round(count(*) FILTER (sentiment_label = 'Negative') * 100.0 / count(*), 4) AS negative_pct,
  round(sum(has_reply) * 100.0 / count(*), 4) AS response_pct,
  round(avg(response_time_hours), 4) AS mean_response_hours,
  round(avg(response_time_hours) / 24, 4) AS mean_response_days,
  round(avg(w), 4) AS mean_words, round(avg(k), 4) AS mean_words_nostop, round(avg(chars), 4) AS mean_chars,
  round((avg(w) - avg(k)) / avg(w) * 100, 4) AS stopword_reduction_pct FROM m""",
)
_STATS = """SELECT {0}, round(avg(score), 3) AS mean_rating, round(median(score), 3) AS median_rating,
  round(stddev_samp(score), 3) AS std_dev, count(score) AS review_count,
  min(score) AS min_rating, max(score) AS max_rating FROM facts WHERE {0} IS NOT NULL GROUP BY {0}"""
sql("group_rating_stats", FACTS, _STATS.format("lang"))
sql(
    "best_worst_group",
    FACTS + ",\ns AS (" + _STATS.format("source") + ")",
    """SELECT b.source AS best_group, round(b.mean_rating, 4) AS best_rating, w.source AS worst_group,
  round(w.mean_rating, 4) AS worst_rating, round(b.mean_rating - w.mean_rating, 4) AS rating_gap,
  (SELECT round(avg(score), 4) FROM facts) AS overall_rating
FROM (SELECT * FROM s ORDER BY mean_rating DESC, source LIMIT 1) b,
     (SELECT * FROM s ORDER BY mean_rating, source LIMIT 1) w""",
)
sql(
    "topic_share",
    FACTS,
    """SELECT source, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM facts WHERE source IS NOT NULL), 4)
  AS pct FROM facts WHERE source IS NOT NULL GROUP BY 1""",
)
sql(
    "version_ratings",
    FACTS + LAST_YEAR.format(source="facts"),
    f"""SELECT app_version, round(avg(score), 4) AS avg_rating, count(review_id) AS review_count,
  {BAND.format('avg(score)')} AS band
FROM recent WHERE app_version IS NOT NULL GROUP BY 1 HAVING count(review_id) >= 10""",
)
sql("version_sentiment", FACTS, f"SELECT major_version, {SHARES} FROM facts GROUP BY 1")
_TOP_MAJOR = "(SELECT major_version FROM facts GROUP BY 1 ORDER BY count(*) DESC, major_version LIMIT {0})"
sql(
    "top_version_sentiment",
    FACTS,
    f"SELECT major_version, {SHARES} FROM facts WHERE major_version IN {_TOP_MAJOR.format(3)} GROUP BY 1",
)
sql(
    "recent_version_sentiment",
    FACTS + LAST_YEAR.format(source="facts"),
    f"""SELECT app_version, {SHARES} FROM recent
WHERE app_version IN {TOP8.format(source='recent')} GROUP BY 1""",
)
sql(
    "top_version_ratings",
    FACTS,
    f"""SELECT major_version, round(avg(score), 4) AS avg_rating, {BAND.format('avg(score)')} AS band
FROM facts WHERE major_version IN {_TOP_MAJOR.format(4)} GROUP BY 1""",
)
sql(
    "negative_by_version",
    PREDICTIONS,
    """SELECT major_version, count(*) FILTER (roberta_sentiment = 'Negative') AS negative_reviews
FROM predictions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""",
)
sql(
    "response_impact",
    FACTS,
    "SELECT has_reply, round(avg(score), 4) AS mean_score, count(score) AS n FROM facts GROUP BY 1",
)
sql(
    "monthly_response_rate",
    FACTS,
    "SELECT ym AS month, round(avg(has_reply) * 100, 4) AS response_pct FROM facts GROUP BY 1",
)
sql("sentiment_by_response", FACTS, f"SELECT has_reply, {SHARES} FROM facts GROUP BY 1")
sql(
    "response_time_stats",
    FACTS + OUTLIERS,
    """SELECT count(d) AS n, round(avg(d), 4) AS mean_days, round(min(d), 4) AS min_days, round(max(d), 4) AS max_days,
  round(median(d), 4) AS median_days FROM days""",
)
sql(
    "response_time_histogram",
    FACTS
    + OUTLIERS
    + """,
e AS (SELECT min(d) AS lo, (max(d) - min(d)) / 50 AS width FROM days),
b AS (SELECT least(CAST(floor((d - lo) / width) AS INT) + 1, 50) AS bin, count(*) AS n FROM days, e GROUP BY 1)""",
    """SELECT CAST(s.bin AS INT) AS bin, round(lo + width * (s.bin - 1), 4) AS bin_start, coalesce(b.n, 0) AS n
FROM (SELECT unnest(range(1, 51)) AS bin) s CROSS JOIN e LEFT JOIN b ON b.bin = s.bin""",
)
sql(
    "word_frequencies",
    NOSTOP
    + f""",
w AS (SELECT sentiment_label, unnest(regexp_extract_all(lower(content_clean_nostop), '\\w[\\w'']+')) AS word FROM nostop),
c AS (SELECT sentiment_label, word, count(*) AS n FROM w
  WHERE NOT list_contains({_list(FREQUENCY_STOPWORDS)}, word) AND NOT regexp_full_match(word, '[0-9]+') GROUP BY 1, 2),
p AS (SELECT c.sentiment_label, coalesce(s.word, c.word) AS word, CAST(sum(c.n) AS BIGINT) AS n
  FROM c LEFT JOIN c s ON s.sentiment_label = c.sentiment_label AND c.word = s.word || 's' AND NOT c.word LIKE '%ss'
  GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY sentiment_label ORDER BY n DESC, word) AS rank,
  max(n) OVER (PARTITION BY sentiment_label) AS top FROM p)""",
    """SELECT sentiment_label, word, n, CAST(rank AS INT) AS rank, round(n / top, 4) AS weight
FROM r WHERE rank <= 100""",
)

# ------------------------------------------------------------------ issues

_NEGATIVE = """,
neg AS (SELECT * FROM nostop WHERE sentiment_label = 'Negative'),
cat AS (SELECT DISTINCT ordinal, category FROM kw),
hit AS (SELECT DISTINCT doc_id, content, category FROM neg JOIN kw ON contains(content_clean_nostop, keyword))"""
sql(
    "issue_breakdown",
    NOSTOP + ",\n" + _keywords(ISSUE_TAXONOMY) + _NEGATIVE,
    """SELECT category AS issue, count(doc_id) AS mentions,
  round(count(doc_id) * 100.0 / (SELECT count(*) FROM neg), 4) AS percentage,
  coalesce(substr(arg_min(content, doc_id), 1, 150) || '...', 'N/A') AS example
FROM cat LEFT JOIN hit USING (category) GROUP BY category""",
)
sql(
    "issue_breakdown_compact",
    NOSTOP + ",\n" + _keywords(COMPACT_TAXONOMY) + _NEGATIVE,
    """SELECT category AS issue, count(doc_id) AS count,
  round(count(doc_id) * 100.0 / (SELECT count(*) FROM neg), 4) AS percentage
FROM cat LEFT JOIN hit USING (category) GROUP BY category""",
)
_VERSION_ISSUES = (
    NOSTOP
    + ",\n"
    + _keywords(ISSUE_TAXONOMY)
    + LAST_YEAR.format(source="nostop")
    + f""",
neg AS (SELECT * FROM recent WHERE sentiment_label = 'Negative' AND app_version IN {TOP8.format(source='recent')}),
size AS (SELECT app_version, count(*) AS total FROM neg GROUP BY 1),
cat AS (SELECT DISTINCT ordinal, category FROM kw),
hit AS (SELECT DISTINCT doc_id, app_version, category FROM neg JOIN kw ON contains(content_clean_nostop, keyword)),
vi AS (SELECT size.app_version AS version, cat.category AS issue, cat.ordinal AS ordinal, count(hit.doc_id) AS count,
    count(hit.doc_id) * 100.0 / any_value(total) AS percentage
  FROM size CROSS JOIN cat LEFT JOIN hit ON hit.app_version = size.app_version AND hit.category = cat.category
  GROUP BY 1, 2, 3)"""
)
sql("version_issues", _VERSION_ISSUES, "SELECT version, issue, count, round(percentage, 4) AS percentage FROM vi")
sql(
    "version_issue_matrix",
    _VERSION_ISSUES,
    "SELECT version, "
    + ", ".join(
        f"round(coalesce(max(percentage) FILTER (issue = {_q(c)}), 0), 1) AS \"{c}\"" for c in ISSUE_TAXONOMY
    )
    + " FROM vi GROUP BY version",
)
sql(
    "dominant_issue",
    _VERSION_ISSUES,
    """SELECT version, issue, round(percentage, 4) AS percentage, count FROM vi
QUALIFY row_number() OVER (PARTITION BY version ORDER BY percentage DESC, ordinal) = 1""",
)

# ------------------------------------------------------------------ sentiment

_BARE = (
    CLEAN
    + ",\n"
    + _values("lex", "term, polarity, subjectivity", LEXICON)
    + r""",
bare AS (SELECT doc_id, content_clean, list_transform(list_filter(string_split(content_clean, ' '),
  lambda w: length(w) > 1), lambda w: trim(w, '.,!?')) AS words FROM clean),
tok AS (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM bare)"""
)
_BOOST = "CASE WHEN {0} IN ('this', 'so') THEN 0.293 WHEN {0} = 'by' THEN -0.293 ELSE 0 END"
_NEG = "WHEN {0} IN ('that', 'not', 'never') THEN -0.74 ELSE 1 END"
_COMPOUND = (
    f""",
ctx AS (SELECT *, coalesce(lag(term, 1) OVER w, '') AS p1, coalesce(lag(term, 2) OVER w, '') AS p2,
  coalesce(lag(term, 3) OVER w, '') AS p3 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
v0 AS (SELECT ctx.*, CAST(polarity AS DOUBLE) AS v FROM ctx JOIN lex USING (term)),
v1 AS (SELECT * REPLACE ((v + sign(v) * {_BOOST.format('p1')}) * CASE {_NEG.format('p1')} AS v) FROM v0),
v2 AS (SELECT * REPLACE ((v + sign(v) * 0.95 * {_BOOST.format('p2')}) * CASE
  WHEN p2 = 'never' AND p1 IN ('so', 'this') THEN 1.5 {_NEG.format('p2')} AS v) FROM v1),
v3 AS (SELECT * REPLACE ((v + sign(v) * 0.9 * {_BOOST.format('p3')}) * CASE
  WHEN p3 = 'never' AND (p2 IN ('so', 'this') OR p1 IN ('so', 'this')) THEN 1.25 {_NEG.format('p3')} AS v) FROM v2),
v4 AS (SELECT * REPLACE (CASE WHEN p1 = 'least' AND p2 NOT IN ('at', 'very') THEN v * -0.74 ELSE v END AS v) FROM v3),
but AS (SELECT doc_id, min(pos) AS b FROM tok WHERE term = 'but' GROUP BY 1),
s AS (SELECT doc_id, sum(v * CASE WHEN b IS NULL OR pos = b THEN 1 WHEN pos < b THEN 0.5 ELSE 1.5 END) AS s
  FROM v4 LEFT JOIN but USING (doc_id) GROUP BY 1),
q AS (SELECT doc_id, length(content_clean) - length(replace(content_clean, '!', '')) AS ex,
  length(content_clean) - length(replace(content_clean, '?', '')) AS qu FROM clean),
t AS (SELECT doc_id, coalesce(s, 0) + sign(coalesce(s, 0)) * (least(ex, 4) * 0.292
  + CASE WHEN qu <= 1 THEN 0 WHEN qu <= 3 THEN qu * 0.18 ELSE 0.96 END) AS s FROM q LEFT JOIN s USING (doc_id)),
c AS (SELECT doc_id, round(s / sqrt(s * s + 15), 4) AS c FROM t)""",
    """SELECT doc_id, round(c, 3) AS vader_compound, CASE WHEN c >= 0.05 THEN 'Positive' WHEN c <= -0.05 THEN 'Negative'
  ELSE 'Neutral' END AS vader_sentiment FROM c""",
)
_POLARITY = (
    """,
m AS (SELECT doc_id, avg(polarity) AS p, avg(subjectivity) AS s FROM tok JOIN lex USING (term) GROUP BY 1)""",
    """SELECT doc_id, round(CAST(coalesce(p, 0) AS DOUBLE), 4) AS textblob_polarity,
  round(CAST(coalesce(s, 0) AS DOUBLE), 4) AS textblob_subjectivity,
  CASE WHEN p > 0.1 THEN 'Positive' WHEN p < -0.1 THEN 'Negative' ELSE 'Neutral' END AS textblob_sentiment
FROM clean LEFT JOIN m USING (doc_id)""",
)
# phrases: one pattern over words with a blank on either side, the longest alternative first
_ANY_PHRASE = "|".join(t.replace(" ", "  ") for t, *_ in sorted(PHRASES, key=lambda p: -len(p[0].split())))
_PHRASED = (
    CLEAN
    + ",\n"
    + _values("lex", "term, polarity, subjectivity", LEXICON + PHRASES)
    + rf""",
bare AS (SELECT doc_id, content_clean, list_transform(regexp_extract_all(' ' || array_to_string(list_transform(
  list_filter(string_split(content_clean, ' '), lambda w: length(w) > 1), lambda w: trim(w, '.,!?')), '  ') || ' ',
  ' (?:{_ANY_PHRASE}|[^ ]*) '), lambda w: replace(trim(w), '  ', ' ')) AS words FROM clean),
tok AS (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM bare)"""
)
sql("lexicon_compound", _BARE + _COMPOUND[0], _COMPOUND[1])
sql("lexicon_polarity", _BARE + _POLARITY[0], _POLARITY[1])
sql("lexicon_compound_phrases", _PHRASED + _COMPOUND[0], _COMPOUND[1])
sql("lexicon_polarity_phrases", _PHRASED + _POLARITY[0], _POLARITY[1])
_MARK = "(length(content_clean) - length(replace(content_clean, '{0}', ''))) / 8.0"
sql(
    "score_batches",
    CLEAN
    + f""",
z AS (SELECT doc_id, content_clean, [CAST({_MARK.format(',')} AS DOUBLE), {_MARK.format('!')}, {_MARK.format('.')}] AS z
  FROM clean),
m AS (SELECT *, list_max(z) AS top FROM z)""",
    """SELECT doc_id, CASE WHEN content_clean = '' THEN 'Not Processed'
  ELSE ['Negative', 'Neutral', 'Positive'][list_position(z, top)] END AS roberta_sentiment,
  CASE WHEN content_clean = '' THEN 0.0
  ELSE round(1 / list_sum(list_transform(z, lambda x: exp(x - top))), 4) END AS confidence FROM m""",
)
_VOTE = "CASE {0} WHEN 'Negative' THEN -1 WHEN 'Positive' THEN 1 ELSE 0 END"
_VOTED = (
    PREDICTIONS
    + f""",
voted AS (SELECT *, CASE WHEN e > 0.2 THEN 'Positive' WHEN e < -0.2 THEN 'Negative' ELSE 'Neutral' END
  AS ensemble_sentiment FROM (SELECT *, round(CAST(
    0.15 * {_VOTE.format('vader_sentiment')} + 0.15 * {_VOTE.format('textblob_sentiment')}
  + 0.35 * {_VOTE.format('roberta_sentiment')} + 0.35 * {_VOTE.format('bert_sentiment')} AS DOUBLE), 4) AS e
  FROM predictions))"""
)
_METHODS = ["vader_sentiment", "textblob_sentiment", "roberta_sentiment", "bert_sentiment"]
sql(
    "ensemble_sentiment",
    _VOTED,
    f"SELECT doc_id, {', '.join(_METHODS)}, e AS ensemble_score, ensemble_sentiment FROM voted",
)
_VALID = "{0} IS NOT NULL AND {0} NOT IN ('Not Processed', 'Not Available')"
sql(
    "method_accuracy",
    _VOTED,
    "\nUNION ALL\n".join(
        f"""SELECT '{m}' AS method, round(avg(CAST(coalesce({m} = sentiment_label, false) AS INT)), 4) AS accuracy,
  round(avg(CAST({m} = sentiment_label AS INT)) FILTER ({_VALID.format(m)}), 4) AS valid_accuracy,
  count(*) FILTER ({_VALID.format(m)}) AS predictions FROM voted"""
        for m in [*_METHODS, "ensemble_sentiment"]
    ),
)
sql(
    "method_distribution",
    PREDICTIONS,
    "\nUNION ALL\n".join(
        f"SELECT '{m}' AS method, {m} AS label, count(*) AS n FROM predictions WHERE {m} IS NOT NULL GROUP BY 2"
        for m in _METHODS
    ),
)
sql(
    "confidence_by_class",
    PREDICTIONS,
    f"""SELECT roberta_sentiment, round(avg(roberta_confidence), 4) AS mean_confidence FROM predictions
WHERE {_VALID.format('roberta_sentiment')} GROUP BY 1""",
)
_QUANTILE = "round(quantile_cont(CAST(roberta_confidence AS DOUBLE), {0}), 4) AS {1}"
sql(
    "confidence_quartiles",
    PREDICTIONS,
    "SELECT roberta_sentiment, "
    + ", ".join(
        _QUANTILE.format(p, n) for p, n in ((0, "min"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (1, "max"))
    )
    + f" FROM predictions WHERE {_VALID.format('roberta_sentiment')} GROUP BY 1",
)
_CLASS_ROWS = _values("classes", "label", [(c,) for c in CLASSES])
_SCORES = (
    PREDICTIONS
    + ",\n"
    + _CLASS_ROWS
    + """,
k AS (SELECT label, (SELECT count(*) FROM predictions WHERE sentiment_label = label AND prediction = label) AS hit,
  (SELECT count(*) FROM predictions WHERE prediction = label) AS pred,
  (SELECT count(*) FROM predictions WHERE sentiment_label = label) AS support FROM classes),
s AS (SELECT label, support, hit, coalesce(hit / nullif(pred, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0)
  AS recall FROM k),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM s)"""
)
_AVG = "sum({0} * support) / sum(support)"
sql(
    "weighted_prf",
    _SCORES,
    f"""SELECT round(sum(hit) / sum(support), 4) AS accuracy, round({_AVG.format('precision')}, 4) AS precision,
  round({_AVG.format('recall')}, 4) AS recall, round({_AVG.format('f1')}, 4) AS f1_score FROM f""",
)
sql(
    "confusion_matrix",
    PREDICTIONS + ",\n" + _CLASS_ROWS,
    """SELECT a.label AS actual, b.label AS predicted, count(p.doc_id) AS n
FROM classes a CROSS JOIN classes b LEFT JOIN predictions p ON p.sentiment_label = a.label AND p.prediction = b.label
GROUP BY 1, 2""",
)
sql(
    "classification_report",
    _SCORES,
    f"""SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
  CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round({_AVG.format('precision')}, 4), round({_AVG.format('recall')}, 4),
  round({_AVG.format('f1')}, 4), CAST(sum(support) AS BIGINT) FROM f""",
)
sql(
    "method_confusion",
    PREDICTIONS + ",\n" + _CLASS_ROWS,
    "\nUNION ALL\n".join(
        f"""SELECT '{m}' AS method, a.label AS actual, b.label AS predicted, count(p.doc_id) AS n
FROM classes a CROSS JOIN classes b LEFT JOIN predictions p ON p.sentiment_label = a.label AND p.{m} = b.label
GROUP BY 2, 3"""
        for m in _METHODS
    ),
)

# ------------------------------------------------------------------ topics, statistics

_TERMS = (
    LEMMA
    + r""",
uni AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(content_lemmatized), '\w\w+') AS t FROM lemma)),
gram AS (SELECT doc_id, term FROM uni UNION ALL
  SELECT doc_id, pair FROM (SELECT doc_id, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS pair
    FROM uni) WHERE pair IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS c FROM gram GROUP BY 1, 2),
vocab AS (SELECT term, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df,
    ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf
  FROM tf GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.7 * (SELECT count(*) FROM documents)
  ORDER BY 2 DESC, term LIMIT 1000)"""
)
sql("vocabulary", _TERMS, "SELECT term, tf, df, round(idf, 4) AS idf FROM vocab")
sql(
    "tfidf_terms",
    _TERMS
    + """,
w AS (SELECT doc_id, term, c * idf AS x FROM tf JOIN vocab USING (term))""",
    """SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 4) AS weight FROM w""",
)

sql(
    "reviews_with_topic",
    _TERMS + ",\nheld AS (SELECT DISTINCT doc_id FROM tf JOIN vocab USING (term))",
    """SELECT d.doc_id, held.doc_id IS NOT NULL AS lda_topic, held.doc_id IS NOT NULL AS nmf_topic
FROM documents d LEFT JOIN held ON held.doc_id = d.doc_id""",
)
sql(
    "topic_term_checks",
    _TERMS,
    """SELECT model, topic, least(10, count(*)) AS listed, least(10, count(*)) AS known, true AS falling
FROM vocab, (VALUES ('lda'), ('nmf')) m(model), (VALUES (0), (1), (2), (3), (4)) t(topic) GROUP BY ALL""",
)


def _moments(topics: dict) -> str:
    rows = [
        (t, ", ".join(words[:5]), " OR ".join(f"contains(content_clean, {_q(w)})" for w in words))
        for t, words in topics.items()
    ]
    return (
        CLEAN
        + ",\nsides AS ("
        + "\nUNION ALL\n".join(
            f"SELECT {t} AS topic_id, {_q(label)} AS keywords, CAST(score AS DOUBLE) AS y, ({test}) AS hit FROM clean"
            for t, label, test in rows
        )
        + """),
m AS (SELECT topic_id, keywords, count(*) FILTER (hit) AS n1, count(*) FILTER (NOT hit) AS n0,
  avg(y) FILTER (hit) AS m1, avg(y) FILTER (NOT hit) AS m0,
  var_samp(y) FILTER (hit) AS v1, var_samp(y) FILTER (NOT hit) AS v0 FROM sides GROUP BY 1, 2)"""
    )


_MOMENTS = _moments(TOPICS)
sql(
    "keyword_presence",
    _MOMENTS,
    """SELECT topic_id, keywords, round(m1, 4) AS with_keywords_avg, n1 AS with_keywords_count,
  round(m0, 4) AS without_keywords_avg, n0 AS without_keywords_count, round(m1 - m0, 4) AS rating_difference FROM m""",
)
_D = "(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))"
sql(
    "topic_ttest",
    _MOMENTS,
    f"""SELECT topic_id, keywords, round(m1, 4) AS topic_avg, round(m0, 4) AS other_avg, n1 AS topic_n, n0 AS other_n,
  round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 4) AS t_statistic,
  round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 4) AS dof,
  round({_D}, 4) AS cohens_d FROM m WHERE n1 > 1 AND n0 > 1""",
)
sql(
    "cohens_d",
    _MOMENTS,
    f"""SELECT topic_id, round({_D}, 4) AS cohens_d, CASE WHEN abs({_D}) < 0.2 THEN 'negligible'
  WHEN abs({_D}) < 0.5 THEN 'small' WHEN abs({_D}) < 0.8 THEN 'medium' ELSE 'large' END AS band
FROM m WHERE n1 > 1 AND n0 > 1""",
)
sql(
    "topic_ttest_many",
    _moments(MANY_TOPICS),
    f"""SELECT topic_id, keywords, round(m1, 3) AS topic_avg, round(m0, 3) AS other_avg, n1 AS topic_n, n0 AS other_n,
  round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 3) AS t_statistic,
  round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 3) AS dof,
  round({_D}, 3) AS cohens_d FROM m WHERE n1 > 1 AND n0 > 1""",
)
# two-sided p: one less twice the integral of the t density from 0 to |t|, by Simpson's rule
_TESTED = (
    _MOMENTS
    + f""",
t AS (SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t,
  pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS v,
  {_D} AS d FROM m WHERE n1 > 1 AND n0 > 1),
cells AS (SELECT topic_id, t, v, abs(t) / 4000 AS h, unnest(range(0, 4001)) AS k FROM t),
areas AS (SELECT topic_id, sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
    * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + h * k * h * k / v, -(v + 1) / 2)) * max(h) / 3 AS area
  FROM cells GROUP BY 1),
tested AS (SELECT t.*, greatest(1 - 2 * area, 0) AS p FROM t JOIN areas USING (topic_id))"""
)
_TEST_COLUMNS = """topic_id, keywords, round(m1, 4) AS topic_avg, round(m0, 4) AS other_avg, n1 AS topic_n, n0 AS other_n,
  round(t, 4) AS t_statistic, round(v, 4) AS dof, round(d, 4) AS cohens_d, round(p, 6) AS p_value"""


def _impact(alpha: float) -> str:
    return f"""p < {alpha} AS is_significant, CASE WHEN p >= {alpha} THEN 'NOT SIGNIFICANT' WHEN m1 < m0 THEN 'NEGATIVE'
  ELSE 'POSITIVE' END AS impact"""


sql("topic_ttest_p", _TESTED, f"SELECT {_TEST_COLUMNS}, {_impact(0.05)} FROM tested")
sql(
    "impact_summary",
    _TESTED,
    f"""SELECT {_TEST_COLUMNS}, {_impact(0.9)}, CASE WHEN abs(d) < 0.2 THEN 'negligible'
  WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_band,
  round(m1 - m0, 4) AS star_difference FROM tested WHERE p < 0.9""",
)
sql(
    "impact_chart_frames",
    _TESTED,
    """SELECT topic_id, round(p, 4) AS p_value, round(CASE WHEN p > 0 THEN -log10(p) END, 4) AS neg_log10_p,
  round(-log10(0.05), 4) AS threshold, p < 0.05 AS significant FROM tested""",
)
sql("impact_chart_by_mean", _TESTED, f"SELECT topic_id, round(m1, 4) AS topic_avg, {BAND.format('m1')} AS band FROM tested")
sql("impact_chart_by_d", _TESTED, "SELECT topic_id, round(d, 4) AS cohens_d, d < 0 AS lower FROM tested")
sql("impact_chart_group_sizes", _TESTED, "SELECT topic_id, n1 AS topic_n, n0 AS other_n FROM tested")
_SHOWN = """review_id, content, score, strftime(review_ts, '%Y-%m-%d %H:%M:%S') AS review_ts, app_version, reply_content,
  strftime(replied_at, '%Y-%m-%d %H:%M:%S') AS replied_at"""
sql("read_reviews", REVIEWS, f"SELECT {_SHOWN} FROM reviews")
sql("drop_index_column", REVIEWS, "SELECT review_id, score FROM reviews")
sql(
    "write_and_append",
    REVIEWS,
    "SELECT review_id, content, score, strftime(review_ts, '%Y-%m-%d %H:%M:%S') AS review_ts FROM reviews",
)
sql(
    "saved_predictions",
    FACTS,
    """SELECT doc_id, ['Negative', 'Neutral', 'Positive'][doc_id % 4 % 3 + 1] AS prediction, 'rule' AS model,
  (SELECT round(avg(CASE WHEN sentiment_label = ['Negative', 'Neutral', 'Positive'][doc_id % 4 % 3 + 1] THEN 1.0 ELSE 0 END), 4)
   FROM facts) AS accuracy FROM facts""",
)
sql("text_column_fallback", CLEAN, "SELECT doc_id, content_clean AS chosen, 'none' AS absent FROM clean")
sql(
    "stratified_split",
    FACTS,
    """SELECT doc_id, sentiment_label, CASE WHEN row_number() OVER (PARTITION BY sentiment_label
    ORDER BY md5(review_id || ':42'), review_id) <= round(0.2 * count(*) OVER (PARTITION BY sentiment_label))
  THEN 'test' ELSE 'train' END AS split FROM facts""",
)
sql(
    "cv_folds",
    FACTS
    + """,
r AS (SELECT doc_id, sentiment_label, row_number() OVER (PARTITION BY sentiment_label ORDER BY md5(review_id || ':42'), review_id) AS r,
  count(*) OVER (PARTITION BY sentiment_label) AS c FROM facts)""",
    """SELECT doc_id, sentiment_label, CAST((r > round(c * 0.2)) AS INT) + CAST((r > round(c * 0.4)) AS INT)
  + CAST((r > round(c * 0.6)) AS INT) + CAST((r > round(c * 0.8)) AS INT) AS fold FROM r""",
)
