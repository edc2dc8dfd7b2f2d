"""Queries over the whole given texts and lines; blank texts and damaged lines on fixtures."""

from codewarden.operators import review
from codewarden.sources import logs
from tests.test_queries import SF_DIR
from verification import spark_queries


def test_reviewable_files_reads_every_text(spark):
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"] for r in spark_queries.reviewable_files(spark, SF_DIR).collect()}
    assert found == {r["doc_id"] for r in texts if (r["text"] or "").strip()}
    rows = [(1, "x"), (2, " \n\t"), (3, ""), (4, None), (9, " y\n")]
    blank = spark.createDataFrame(rows, "doc_id long, content string")
    assert sorted(r["doc_id"] for r in review.reviewable(blank).collect()) == [1, 9]


def test_log_lines_come_back_whole(spark):
    log = spark_queries.log(spark, SF_DIR).checkpoint()
    back = spark_queries.log_json_roundtrip(spark, SF_DIR)
    assert back.count() == log.count() > 0
    lines = [r["value"] for r in logs.to_json_lines(log).limit(4).collect()]
    damaged = [lines[0], lines[1][:-5], "", "{", lines[2], "no json", lines[3]]
    read = logs.parse_log_lines(spark.createDataFrame([(x,) for x in damaged], "value string"))
    assert read.count() == 3
