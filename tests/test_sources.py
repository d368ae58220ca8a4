import datetime as dt

from pyspark.sql import functions as F

from revlens.sources import sinks
from revlens.sources.reviews import drop_index_column, parse_timestamps
from tests.conftest import rows


def by_id(df):
    return {r["review_id"]: r for r in rows(df)}


def test_csv_columns_types_and_extra_columns(raw):
    assert raw.columns == [
        "review_id", "content", "score", "review_ts", "replied_at", "reply_content", "app_version", "thumbsUpCount",
    ]
    kinds = dict(raw.dtypes)
    assert kinds["score"] == "int" and kinds["review_ts"] == "timestamp_ntz"
    assert raw.count() == 40


def test_multiline_quotes_and_nulls(raw):
    found = by_id(raw)
    assert found["a04"]["content"] == 'First line\nsecond "quoted" line'
    assert found["a03"]["content"] is None and found["a13"]["score"] is None
    assert found["a04"]["app_version"] is None


def test_bad_dates_become_null(raw):
    found = by_id(raw)
    assert found["a14"]["review_ts"] is None and found["a15"]["review_ts"] is None
    assert found["a01"]["review_ts"] == dt.datetime(2024, 1, 5, 9, 7)
    assert found["a04"]["review_ts"] == dt.datetime(2024, 2, 29)


def test_timestamp_format_is_a_parameter(spark):
    df = spark.createDataFrame([("2024-02-03 04:05:06",), ("x",)], "review_ts string")
    out = parse_timestamps(df, ("review_ts",), "yyyy-MM-dd HH:mm:ss").collect()
    assert [r[0] for r in out] == [dt.datetime(2024, 2, 3, 4, 5, 6), None]


def test_index_column_is_dropped(spark):
    df = spark.createDataFrame([(1, 2)], "_c0 int, x int")
    assert drop_index_column(df).columns == ["x"]


def test_write_and_append(spark, raw, tmp_path):
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        table = raw.select("review_id", "content")
        sinks.write_table(table, path, fmt)
        sinks.write_table(table, path, fmt)
        assert sinks.read_table(spark, path, fmt).count() == 40
        sinks.append_table(table.limit(3), path, fmt)
        again = sinks.read_table(spark, path, fmt)
        assert again.count() == 43
        assert again.where(F.col("content").contains("\n")).count() >= 1


def test_partitioned_write_prunes(spark, enriched, tmp_path):
    path = str(tmp_path / "by_year")
    sinks.write_table(enriched.select("review_id", "year"), path, partition_by=("year",))
    assert sinks.read_table(spark, path).where("year = 2023").count() == 1
