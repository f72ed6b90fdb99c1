"""Retrieval of short questions and of questions that no document holds, against brute force."""

import math
from collections import Counter

from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import text

DOCS = {1: "red fox", 2: "the red fox and the red fox ran", 3: "fox", 4: "a blue whale swam by", 5: "", 6: "blue sky over the sea", 7: "redfox"}
ASKED = {1: "Red fox", 2: "fox", 3: "a blue whale swam by", 4: "whale in the blue sea", 5: "?", 6: "blue whale song", 7: "red fox and the red fox"}


def frames(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "id long, description string")
    return docs, spark.createDataFrame(list(ASKED.items()), "question_id long, question string")


def phrase_hits():
    out = {}
    for q, asked in ASKED.items():
        p = asked.lower().split() if asked != "?" else []
        for d, t in DOCS.items():
            w = t.split()
            n = sum(w[i : i + len(p)] == p for i in range(len(w))) if p else 0
            if n:
                out[q, d] = n
    return out


def test_short_questions(spark):
    docs, asked = frames(spark)
    got = text.phrases_by_question(text.indexed(docs, "description"), "w_description", asked).collect()
    assert Counter((r["question_id"], r["id"], r["tf"]) for r in got) == Counter((q, d, n) for (q, d), n in phrase_hits().items())


def slots(spark, texts):
    rows = spark.createDataFrame([(t,) for t in sorted({w for x in texts for w in x.lower().replace("?", "").split()})], "t string")
    slot, sign = exprs.hash_slot(F.col("t"), 512)
    return {r["t"]: (r["slot"], r["sign"]) for r in rows.select("t", slot.alias("slot"), sign.alias("sign")).collect()}


def test_questions_without_a_hit_get_similar_documents(spark):
    docs, asked = frames(spark)
    got = text.retrieved(docs, "description", asked, 2).collect()
    place = slots(spark, [*DOCS.values(), *ASKED.values()])

    def vector(t):
        v = Counter()
        for w, n in Counter(t.lower().replace("?", "").split()).items():
            v[place[w][0]] += place[w][1] * (1 + math.log(n))
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {s: x / norm for s, x in v.items()}

    hits, expected = phrase_hits(), set()
    for q, t in ASKED.items():
        found = [(-n, d) for (p, d), n in hits.items() if p == q]
        how = "phrase" if found else "similar"
        if not found:
            v = vector(t)
            found = [(-round(sum(x * u[s] for s, x in v.items() if s in u), 6), d) for d, x in DOCS.items() for u in [vector(x)] if set(u) & set(v)]
        expected |= {(q, d, how, n + 1) for n, (_, d) in enumerate(sorted(found)[:2])}
    assert {(r["question_id"], r["id"], r["how"], r["rank"]) for r in got} == expected
    assert {q for q, _, how, _ in expected if how == "similar"} == {4, 6}


def test_words_are_exchanged_within_their_text(spark):
    """Vectors and phrases pair rows by text: no row for each word goes through an exchange or a join of words."""
    docs, asked = frames(spark)
    plan = text.vectors(docs, "description")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "token" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    plan = text.phrases_by_question(text.indexed(docs, "description"), "w_description", asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "xxhash64" not in plan


def test_vectors_of_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "fox 中文"), (1, None), (2, ""), (3, None), (4, "red fox fox 中文")], "id long, description string")
    got = {r["id"]: dict(zip(r["slots"], r["weights"])) for r in text.vectors(docs, "description").collect()}
    assert got.keys() == {1, 4} and got[1].keys() == got[4].keys() and all(abs(got[1][k] - got[4][k]) < 1e-12 for k in got[1])
    assert abs(sum(w * w for w in got[1].values()) - 1) < 1e-12
