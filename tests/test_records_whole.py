"""Wiped and re-extracted records, terms of several words, contexts and tools' texts."""

from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import answers, extraction, groups, ledger, places


def test_a_wipe_leaves_other_records_alone(spark):
    rows = [(1, "a.jpg", "Deed", "1900", "sold", "note", 1, 5), (2, "b.jpg", "Bill", None, None, None, 1, 6)]
    df = spark.createDataFrame(rows, "id long, filename string, title string, date_depicted string, description string, annotation string, is_key_evidence int, pages int")
    got = {r["id"]: tuple(r) for r in ledger.wiped(df, F.col("id") == 2).collect()}
    assert got[1] == rows[0] and got[2] == (2, "b.jpg", "b.jpg", None, "Extraction failed: metadata wiped", None, 0, 6)
    assert {r["id"]: tuple(r) for r in ledger.wiped(df, F.lit(False)).collect()} == {r[0]: r for r in rows}
    bare = ledger.wiped(spark.createDataFrame([(1,), (2,)], "id long"), F.col("id") == 1).collect()
    assert {r["id"]: r["description"] for r in bare} == {1: "Extraction failed: metadata wiped", 2: None}


def test_extracted_again(spark):
    docs = spark.createDataFrame([(1, "x", "Old", None, "mine", 1, "t0"), (2, "y", "Other", "Box 2", None, 0, "t0"), (3, "x", "Copy", "Box 3", None, 0, "t0")], "id long, sha256 string, title string, source_archive string, annotation string, is_key_evidence int, updated_at string")
    fresh = spark.createDataFrame([("x", None, "unused"), ("z", "Nobody", "")], "sha256 string, title string, language string")
    got = {r["id"]: tuple(r)[1:] for r in extraction.reextracted(docs, fresh, F.lit("Box 9"), F.lit("t1")).collect()}
    assert got == {1: ("x", None, "Box 9", "mine", 1, "t1"), 2: ("y", "Other", "Box 2", None, 0, "t0"), 3: ("x", None, "Box 3", None, 0, "t1")}


def test_terms_of_several_words(spark):
    docs = {1: "New York, new york city", 2: "york new", 3: "A New-York minute", 4: None, 5: "", 6: "city of new"}
    terms = ["New York", "York", "new york city", "of", "", "the end", "York City of"]
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    got = {(r["id"], r["term"]) for r in places.mentions(df, "text", spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    words = {i: f" {(t or '').lower().replace(',', ' ').replace('-', ' ')} ".replace("  ", " ") for i, t in docs.items()}
    assert got == {(i, t) for i, w in words.items() for t in terms if t and f" {t.lower()} " in w}
    assert places.mentions(df, "text", spark.createDataFrame([("",)], "term string")).collect() == []


def test_a_long_text_is_not_sent_with_each_of_its_words(spark):
    df = spark.createDataFrame([(1, "new york " * 20_000)], "id long, text string")
    found = places.mentions(df, "text", spark.createDataFrame([("new york",), ("york new york",)], "term string"))
    assert found.count() == 2


def test_contexts(spark):
    hits = spark.createDataFrame([(1, "document", 5, 2), (1, "document", 4, 1), (1, "group", 5, 1), (2, "document", 9, 1)], "question_id long, kind string, id long, rank int")
    records = spark.createDataFrame([("document", 4, None, None, "", None, ""), ("document", 5, "Deed", "1900", "Rome", "sold", "seen"), ("group", 5, "Set", "", None, "two pages", None), ("document", 9, "Lone", None, None, "", None)], "kind string, id long, title string, date string, location string, description string, annotation string")
    money = spark.createDataFrame([("document", 5, "1901", "Ann", None, "12.5", "USD", "Hall", None, "Rome", "fast"), ("document", 5, None, "", "Bob", None, None, None, "7", None, None), ("group", 5, "1800", None, None, "3.0", None, None, None, None, None)], "kind string, id long, date string, seller string, buyer string, price string, currency string, auction_house string, lot_number string, location string, notes string")
    got = {r["question_id"]: (r["records"], r["transactions"]) for r in answers.contexts(hits, records, money).collect()}
    assert got[1][0] == "[Doc #4] Untitled\nDate: Unknown\nLocation: Unknown\nDescription: \n\n[Doc #5] Deed\nDate: 1900\nLocation: Rome\nDescription: sold\nResearcher note: seen\n\n[Doc #5] (multi-page group) Set\nDate: Unknown\nLocation: Unknown\nDescription: two pages"
    assert got[1][1] == "[Doc #5] | Buyer: Bob\n[Doc #5] | Date: 1901 | Seller: Ann | Price: 12.5 USD | Auction: Hall lot  | Location: Rome | Notes: fast\n[Doc #5] | Date: 1800 | Price: 3.0 "
    assert got[2] == ("[Doc #9] Lone\nDate: Unknown\nLocation: Unknown\nDescription: ", answers.NO_TRANSACTIONS)


def test_tool_texts(spark):
    found = spark.createDataFrame([(1, "A", "1900", "<mark>x</mark> y", 1), (2, None, None, "", 2), (3, "C", "", None, None)], "id long, title string, date string, snippet string, place int")
    assert answers.found_text(found, "x").first()["text"] == "Found 3 document(s) matching 'x':\n\n• [Doc #1] A (1900)\n  …<mark>x</mark> y…\n• [Doc #2] Untitled (date unknown)"
    assert answers.found_text(found.limit(0), "x").first()["text"] == "No documents found matching 'x'."
    entity = spark.createDataFrame([(1, "Ann", "person"), (2, "Bob", "person")], "id long, name string, type string")
    seen = spark.createDataFrame([(1, i, f"T{i}", None if i == 0 else f"{1900 + i}", None) for i in range(40)], "entity_id long, document_id long, title string, date string, role string")
    near = spark.createDataFrame([(1, "Cy", "place", 3, 1)] + [(1, "No", "place", 1, n) for n in (11, 12)], "entity_id long, name string, type string, shared long, place int")
    got = {r["id"]: r["text"] for r in answers.entity_text(entity, seen, near).collect()}
    assert got[2] == "# Entity: Bob (Person)\n**Documents:** 0\n\n**Document Appearances:**"
    assert got[1].startswith("# Entity: Ann (Person)\n**Documents:** 30\n\n**Document Appearances:**\n  • [Doc #1] T1 (1901) — \n") and got[1].endswith("\n\n**Frequently Co-occurs With:**\n  • Cy (place) — 3 document(s)") and "T31" not in got[1]


def test_audit_values(spark):
    df = spark.createDataFrame([(1, [1, None], {"a": None}, None, "é" * 1001)], "n long, l array<int>, m map<string,string>, s string, description string")
    kinds = dict(df.dtypes)
    r = df.select(*(exprs.audit_json(c, F.col(c), kinds[c]).alias(c) for c in df.columns)).first()
    assert (r["n"], r["l"], r["s"]) == ("1", "[1,null]", None) and r["description"].endswith("… [truncated, original length 1001]")


def test_merged_rows(spark):
    pages = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "group_id long, page long, document_id long")
    txns = spark.createDataFrame([(10, "a"), (10, "a"), (11, "b"), (99, "c")], "document_id long, seller string")
    assert sorted(tuple(r) for r in groups.merged_transactions(pages, txns).collect()) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b")]
    tags = spark.createDataFrame([(10, "x"), (11, "x"), (12, "y")], "document_id long, tag string")
    assert sorted(tuple(r) for r in groups.merged_tags(pages, tags).collect()) == [(1, "x"), (2, "y")]
