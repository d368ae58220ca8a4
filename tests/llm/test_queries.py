"""The registered corpus queries over a given table, with SQL where there is one; the pipeline."""

import os

import duckdb
import pytest

import corpus_pipeline
from revlens.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import documents, prose

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_answer_for_every_row(spark, name):
    source = {"op3_html_main_text": "pages", "op12_ranked_search": "benchmark", "op13_centroid_clusters": "embeddings"}.get(name, "documents")
    got = QUERIES[name](spark, DATA)
    rows = spark.read.parquet(f"{DATA}/{source}.parquet").count()
    if name.startswith("op1_"):
        assert 0 < got.select("doc_id").distinct().count() < rows
    elif name.startswith("op2_"):
        assert got.filter("piece = 0").count() == rows
    elif name.startswith("op12_"):
        assert got.select("item_id").distinct().count() == rows
    else:
        assert got.count() == rows


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for given in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {given} AS SELECT * FROM '{DATA}/{given}.parquet'")
    want = con.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


def clean(seed):
    return ". ".join(prose(seed * 10 + k, 15, pool=500) for k in range(6)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts and one text for each stage to act on."""
    texts = [clean(k) for k in range(200)]
    item = prose(9001, 40, pool=500)
    line = prose(9100, 16, pool=500)
    special = {
        "short": "too few words",
        "near": texts[3][:150].rpartition(" ")[0] + "\n" + texts[3][:150].rpartition(" ")[2] + texts[3][150:],
        "copy": texts[4],
        "leak": clean(300) + " " + item + " " + clean(301),
        "line a": line + "\n" + clean(302),
        "line b": clean(303) + "\n  " + line + " ",
        "null": None,
    }
    at = {name: 200 + k for k, name in enumerate(special)}
    path = str(tmp_path_factory.mktemp("tables"))
    documents(spark, texts + list(special.values())).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, special, at


def test_every_stage_of_the_pipeline(spark, corpus):
    path, texts, special, at = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        seen.append({r["doc_id"]: r.asDict() for r in docs.collect()})
        if name != "best-fit packing":
            assert docs.columns == columns
    quality, lines, near, leaks, packed = seen
    everything = set(range(200)) | set(at.values())
    assert everything - set(quality) <= {at["short"], at["null"], *range(200)} and len(quality) >= 203
    assert {at["short"], at["null"]} & set(quality) == set()
    assert set(lines) == set(quality)
    assert lines[at["line b"]]["text"] == special["line b"].split("\n")[0]
    assert lines[at["line b"]]["n_chars"] == len(lines[at["line b"]]["text"])
    assert lines[at["line a"]]["text"] == special["line a"]
    assert set(near) == set(lines) - {at["near"]} and lines[at["copy"]]["text"] == ""
    assert set(leaks) == set(near) - {at["leak"]}
    assert set(packed) == set(leaks)


def test_run_is_the_stages_in_order(spark, corpus):
    path = corpus[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    want = sorted(tuple(r[k] for k in key) for r in docs.collect())
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(tuple(r[k] for k in key) for r in got) == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in pieces) <= 2048 for pieces in by_sequence.values())


def test_line_dedup_keeps_the_callers_columns(spark):
    line = "one line that stands in both of these documents"
    docs = documents(spark, [f"{line}\nfirst text", f"second text\n{line}", None, ""]).selectExpr("*", "77 AS n_removed", "doc_id AS n_lines", "'x' AS row")
    got = corpus_pipeline.line_dedup(spark, docs, "")
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted((r["doc_id"], r["text"], r["n_removed"], r["n_lines"], r["row"]) for r in got.collect()) == [
        (0, f"{line}\nfirst text", 77, 0, "x"), (1, "second text", 77, 1, "x"), (2, None, 77, 2, "x"), (3, "", 77, 3, "x"),
    ]


def test_stages_take_empty_tables(spark, corpus):
    none = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, corpus[0])
        assert got.count() == 0, name
        assert name == "best-fit packing" or got.columns == none.columns
