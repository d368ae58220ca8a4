"""The corpus queries that SQL can express, as SQL for DuckDB over the same tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM starts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (
    SELECT words.doc_id, sha256(string_agg(word, ' ' ORDER BY words.pos)) AS h, count(*) AS n
    FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos
    WHERE gone.pos IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, coalesce(kept.h, sha256('')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared >= 75 * (x.n + y.n - shared)
),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a, least(a, min(b)) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, d.doc_id = coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_of ON least_of.a = d.doc_id
"""

TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED = f"""
WITH d AS (SELECT doc_id, {TERMS} AS t FROM documents),
sized AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
wanted AS (SELECT DISTINCT item_id, unnest(t) AS term FROM (SELECT item_id, {TERMS} AS t FROM benchmark)),
posted AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM sized) GROUP BY ALL),
weighed AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM posted, whole GROUP BY term, n_docs
),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM wanted JOIN posted USING (term) JOIN weighed USING (term), whole GROUP BY item_id, doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def _round(r: int) -> str:
    """Distances, nearest centroids and new centroids of round ``r``, from the centroids c{r}."""
    return f"""
d{r} AS (SELECT vec_id, c, CAST(sum((x - v) * (x - v)) AS BIGINT) AS d2 FROM x JOIN c{r} USING (p) GROUP BY vec_id, c),
a{r} AS (SELECT vec_id, c, d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, c) AS k FROM d{r}) WHERE k = 1),
s{r} AS (SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY c, p),
c{r + 1} AS (SELECT c, p, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{r} LEFT JOIN s{r} USING (c, p))"""


CLUSTERED = f"""
WITH kept AS (
    SELECT vec_id, embedding AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64
),
x AS (SELECT vec_id, p, CAST(floor(64 * CAST(e[p] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, e, unnest(range(1, 65)) AS p FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept QUALIFY c < 16),
c0 AS (SELECT c, p, x AS v FROM x JOIN first USING (vec_id)),
{",".join(_round(r) for r in range(4))},
sums AS (SELECT c, sum(d2) AS s FROM a3 GROUP BY c),
names AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p)) AS h FROM c3 GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, d2 AS distance, CAST(s AS BIGINT) AS cluster_inertia,
    CAST((SELECT sum(s) FROM sums) AS BIGINT) AS inertia, h AS centroid_sha256
FROM a3 JOIN sums USING (c) JOIN names USING (c)
"""

ORACLE: dict[str, str] = {
    "op9_substring_dedup": SUBSTRINGS,
    "op10_minhash_near_dedup": NEAR_DUPLICATES,
    "op12_ranked_search": RANKED,
    "op13_centroid_clusters": CLUSTERED,
}
