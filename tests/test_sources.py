"""Files, extraction and sinks end to end, and ingest that takes each content once."""

import json

from folioworks.operators import extraction, text
from folioworks.sources import files, sinks
from folioworks.streaming import ingest


def test_scan_extract_decode(spark, tmp_path):
    folder = tmp_path / "photos"
    folder.mkdir()
    for name, body in (("a.JPG", b"1"), ("b.png", b"2"), ("c.txt", b"3"), ("d.tif", b"4")):
        (folder / name).write_bytes(body)
    found = files.scan(spark, f"file://{folder}")
    assert {(r["filename"], r["media_type"]) for r in found.collect()} == {("a.JPG", "image/jpeg"), ("b.png", "image/png"), ("d.tif", "image/tiff")}

    def extractor(name):
        if name == "d.tif":
            raise OSError("unreadable")
        body = {"title": name, "date_depicted": "Date Unknown", "medium": "Letter", "transactions": [{"seller": "S", "price": "1,200"}, {"seller": "", "price": "x"}], "entities": [{"name": " Ann  B ", "type": "person"}], "tags": ["t"]}
        return "```json\n" + json.dumps(body) + "\n```"

    rows = extraction.decoded(extraction.extracted(found, extractor, pause=0.0))
    by = {r["filename"]: r for r in rows.collect()}
    assert by["a.JPG"]["title"] == "a.JPG" and by["a.JPG"]["date_depicted"] is None and by["a.JPG"]["medium_category"] == "letter"
    assert by["d.tif"]["description"].startswith(extraction.FAILED)
    assert [(r["seller"], r["price"]) for r in extraction.transactions(rows.where("filename = 'a.JPG'")).collect()] == [("S", 1200.0)]
    assert {r["normalized_name"] for r in extraction.mentions(rows).collect()} == {"ann b"}
    assert extraction.decoded(extraction.extracted(found)).count() == 3


def test_ingest_once(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "sha256 string, n int").write.parquet(source)
    for run in ("one", "two"):
        stream = spark.readStream.schema("sha256 string, n int").parquet(source)
        ingest.ingest_once(stream, f"file://{tmp_path}/archive", f"file://{tmp_path}/{run}")
    assert sorted(r["sha256"] for r in spark.read.parquet(f"file://{tmp_path}/archive").collect()) == ["a", "b"]


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([("transaction", 1, None)], "type string, record_id long, date string")
    sinks.timeline_csv(events, f"file://{tmp_path}/csv")
    got = spark.read.option("header", True).csv(f"file://{tmp_path}/csv")
    assert tuple(c.removeprefix(sinks.MARK) for c in got.columns) == sinks.TIMELINE_COLUMNS and got.count() == 1
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes()[:7] == b"\xef\xbb\xbfdate"
    sinks.json_lines(events, f"file://{tmp_path}/json")
    assert json.loads(spark.read.text(f"file://{tmp_path}/json").first()["value"])["record_id"] == 1
    assert sinks.report(events, "#%d", "record_id").first()["line"] == "#1"


def test_queries_parse():
    assert text.escaped('"a  B"') == ("phrase", ["a", "b"])
    assert text.escaped(" x ") == ("prefix", ["x"])
    assert text.escaped('"') == ("empty", [])


def test_dense_and_sparse_cosine_agree(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the cat ran"), (3, "")], "id long, body string")
    e = text.embedding(docs, "body")
    sparse = {(r["query_id"], r["id"]): r["score"] for r in text.similar(e, e, 5).collect()}
    dense = e.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    other = dense.select(F.col("id").alias("id2"), F.col("v").alias("v2"))
    for r in dense.crossJoin(other).select("id", "id2", F.round(text.cosine(F.col("v"), F.col("v2")), 6).alias("c")).collect():
        assert abs(sparse[r["id2"], r["id"]] - r["c"]) < 1e-5
