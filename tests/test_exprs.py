"""Scalar functions on literals, with the awkward cases."""

import pytest
from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import entities, groups, ledger, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


@pytest.mark.parametrize("given, expected", [(None, ""), ("", ""), ("  Larry \t Sickman ", "larry sickman"), ("École", "école")])
def test_normalized_name(spark, given, expected):
    assert value(spark, exprs.normalized_name(lit(given))) == expected


@pytest.mark.parametrize("given, expected", [("letter with invoice", "letter"), ("Banknote", "memo"), (None, "other"), ("", "other"), ("Bill of Sale", "transaction record"), ("photo", "artifact photograph")])
def test_medium(spark, given, expected):
    assert value(spark, exprs.medium_category(lit(given))) == expected


@pytest.mark.parametrize("given, expected", [("1,200", 1200.0), (" 3.5 ", 3.5), ("12d", None), ("about 5", None), (None, None), ("-1e3", -1000.0)])
def test_price(spark, given, expected):
    assert value(spark, exprs.price(lit(given))) == expected


def test_tokens_cjk(spark):
    assert value(spark, exprs.tokens(F.lit("Café 上海 X1"))) == ["上", "海", "café", "x1"]


@pytest.mark.parametrize(
    "given, expected",
    [("Kansas City, Missouri, USA", ["Kansas City", "Missouri"]), ("China (Shanghai, Tientsin); Kansas City", ["China", "Shanghai", "Tientsin", "Kansas City"]), ("Cambridge, MA (Harvard University)", ["Cambridge"]), (None, [])],
)
def test_places(spark, given, expected):
    assert value(spark, exprs.places(lit(given))) == expected


@pytest.mark.parametrize("answer, expected", [("[Doc #1] [Doc #2] [Doc #3]", "high"), ("[Doc #1] [Doc #1]", "medium"), ("They do not contain it", "none"), ("Well", "low")])
def test_confidence(spark, answer, expected):
    assert value(spark, exprs.confidence(F.lit(answer))) == expected


def test_label_and_score(spark):
    s, n = F.lit("A"), F.lit(None).cast("string")
    assert value(spark, exprs.transaction_label(s, F.lit("B"), F.lit(1234.5), F.lit("USD"), F.lit("H"))) == "H · A → B · USD 1,234"
    assert value(spark, exprs.transaction_label(n, n, F.lit(0.0), F.lit("USD"), n)) == "Transaction"
    assert value(spark, exprs.transaction_score(s, F.lit(" "), n, F.lit(0.0), n)) == 2


def test_long_field(spark):
    assert value(spark, exprs.audit_value("description", F.repeat(F.lit("x"), F.lit(1001)))).endswith("… [truncated, original length 1001]")


def test_phrase_overlap(spark):
    assert value(spark, text.occurrences(F.lit(" a a a "), F.lit("a a")).cast("int")) == 1
    assert value(spark, text.occurrences(F.lit(" a b a b c "), F.lit("a b")).cast("int")) == 2


def test_links_with_null_roles_stay(spark):
    links = spark.createDataFrame([(1, 5, "x"), (1, 6, "x"), (1, 5, None), (1, 6, None)], "document_id long, entity_id long, role string")
    assert entities.merged(links, 5, 6).count() == 3


def test_mode_ties_go_to_the_first(spark):
    pages = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (2, 1, None)], "group_id long, page long, place string")
    assert groups.most_common(pages, "place").collect()[0]["place"] == "b"


def test_history_needs_a_test(spark):
    with pytest.raises(ValueError):
        ledger.history(spark.range(1))


def test_new_ids_continue(spark):
    ents = spark.createDataFrame([(7, "ann", "person")], "id long, normalized_name string, type string")
    names = spark.createDataFrame([("Zoe", "person"), (" ANN", "person"), ("Bob", "person"), ("", "person")], "name string, type string")
    none = spark.createDataFrame([], "entity_id long, normalized_name string")
    assert {(r["normalized_name"], r["id"]) for r in entities.resolved(names, ents, none).collect()} == {("ann", 7), ("bob", 8), ("zoe", 9)}
