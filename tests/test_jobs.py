"""Retries, resumption, leases, tables that change at once, and relations from answers."""

import json

import pytest
from pyspark.sql import functions as F

from folioworks.operators import jobs, relations
from folioworks.sources import lease, shared
from folioworks.sources.versions import Fenced, Table
from folioworks.streaming import ingest


def test_pauses():
    waits = []
    policy = jobs.Policy(tries=4, sleep=waits.append)

    def call(request, attempt):
        raise [jobs.RetryAfter(7), jobs.RetryAfter(), ValueError("no")][attempt] if attempt < 3 else ValueError("last")

    assert jobs.attempted(call, "x", policy) == (4, 7 + 10 + 4, "dead", None, "ValueError: last") and waits == [7, 10, 4]
    assert jobs.attempted(lambda r, n: r + str(n), "x", policy) == (1, 0.0, "ok", "x0", None)


def once(request, attempt):
    return f"first {request}"


def broken(request, attempt):
    raise SystemExit(1)  # no Exception: the task fails, as if its executor were lost


def again(request, attempt):
    if request == "r3":
        raise jobs.Permanent("gone")
    return f"second {request}"


def third(request, attempt):
    return f"third {request}"


def test_a_job_redoes_only_what_is_not_there(spark):
    items = spark.range(10).select(F.col("id").alias("key"), F.concat(F.lit("r"), "id").alias("request"))
    path, quiet = shared.place(spark, "job"), jobs.Policy(sleep=lambda s: None)
    assert jobs.mapped(items.where("key < 3"), once, path, quiet).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        jobs.mapped(items, broken, path, quiet)
    got = {r["key"]: r["result"] for r in jobs.mapped(items, again, path, quiet, wave=3).collect()}
    assert got == {k: "first r%d" % k if k < 3 else None if k == 3 else "second r%d" % k for k in range(10)}
    done = jobs.mapped(items, third, path, quiet)
    assert {r["key"] for r in jobs.dead(done).collect()} == {3} and jobs.results(items, path).read().count() == 10
    done = jobs.mapped(items, third, path, quiet, again=True)
    assert done.where("key = 3").first()["result"] == "third r3" and jobs.dead(done).count() == 0 and done.count() == 10
    assert jobs.mapped(items.limit(0), once, shared.place(spark, "none"), quiet).count() == 0


def test_one_holder_at_a_time(spark):
    folder, now = shared.place(spark, "lease"), [100.0]
    one = lease.acquire(spark, folder, "one", 10, lambda: now[0])
    assert one.fence == 1 and lease.acquire(spark, folder, "two", 10, lambda: now[0]) is None
    now[0] = 109
    one.renew()
    now[0] = 115
    assert lease.acquire(spark, folder, "two", 10, lambda: now[0]) is None
    now[0] = 120  # `one` is dead
    two = lease.acquire(spark, folder, "two", 10, lambda: now[0])
    assert two.fence == 2
    with pytest.raises(lease.Lost):
        one.renew()
    one.release()
    assert lease.acquire(spark, folder, "three", 10, lambda: now[0]) is None
    two.release()
    assert lease.acquire(spark, folder, "three", 10, lambda: now[0]).fence == 3


def test_two_who_see_the_same_end_of_a_lease(spark, monkeypatch):
    folder = shared.place(spark, "lease")
    lease.acquire(spark, folder, "dead", 10, lambda: 0.0)
    seen = lease.log.last(spark, folder)
    monkeypatch.setattr(lease.log, "last", lambda *_: seen)
    got = [lease.acquire(spark, folder, name, 10, lambda: 99.0) for name in ("a", "b")]
    assert got[0] is not None and got[1] is None


def test_a_holder_that_comes_back_late_writes_nothing(spark):
    path, schema = shared.place(spark, "ingest"), "sha256 string, prefix string"
    files = spark.createDataFrame([("aa1",), ("ab2",), ("aa1",)], "sha256 string")
    now = [0.0]

    def slow(archive, held):
        now[0] += 1000  # its time is over, and another comes
        assert ingest.exclusive(spark, path, "two", lambda a, h: ingest.take(files, a, h.fence), schema, 10, lambda: now[0]) == {"status": "started", "taken": 2}
        return ingest.take(spark.createDataFrame([("cc3",)], "sha256 string"), archive, held.fence)

    with pytest.raises(Fenced):
        ingest.exclusive(spark, path, "one", slow, schema, 10, lambda: now[0])
    assert sorted(r["sha256"] for r in Table(spark, f"{path}/archive", schema).read().collect()) == ["aa1", "ab2"]


def test_readers_have_the_old_table_or_the_new(spark):
    table = Table(spark, shared.place(spark, "table"), "id long, name string")
    assert table.read().count() == 0
    table.append(spark.createDataFrame([(1, "a")], "id long, name string"))
    table.append(spark.createDataFrame([("b", 2)], "name string, id long"))
    old = table.read()
    table.replace(spark.createDataFrame([(9, "z")], "id long, name string"), fence=2)
    assert {r["id"] for r in old.collect()} == {1, 2} and {r["id"] for r in table.read().collect()} == {9}
    with pytest.raises(Fenced):
        table.append(old, fence=1)


NAMES = {1: "Ann Lee", 2: "Bob Stone", 3: "ann lee"}


def answered(spark, answers):
    rows = [(a, b, NAMES[a], NAMES[b], x) for a, b, x in answers]
    return spark.createDataFrame(rows, "source long, target long, a_name string, b_name string, answer string")


def rel(subject, verb, object_, confidence, ids=(5,)):
    return {"subject": subject, "verb": verb, "object": object_, "confidence": confidence, "evidence_doc_ids": list(ids)}


def said(*rels):
    return json.dumps({"relationships": list(rels)})


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        (said(rel("Ann Lee", " Sells To ", "bob stone", 0.8)), {(1, 2, "sells to", 0.8, "[5]")}),
        ("```json\n" + said(rel("Stone", "pays", "Miss Ann Lee", "0.4", ())) + "\n```", {(2, 1, "pays", 0.4, "[]")}),
        (said(rel("Ann Lee", "knows", "Bob Stone", 0.39), rel("Ann Lee", "", "Bob Stone", 1), rel("", "x", "Bob Stone", 1), rel("Eve", "x", "Bob Stone", 1)), set()),
        (said(rel("Ann Lee", "knows", "Ann Lee", 1)), set()),
        (said(rel("Ann Lee", "knows", "Bob Stone", 0.5), rel("Ann Lee", "KNOWS", "Bob Stone", 0.9, (7, 8))), {(1, 2, "knows", 0.9, "[7,8]")}),
        (said(rel("Ann Lee", "knows", "Bob Stone", 0.5), rel("Ann Lee", "likes", "Bob Stone", "surely")), set()),
        (said(), set()),
        ("they know each other", set()),
        (None, set()),
        (said({"subject": "Ann Lee", "verb": "owes", "object": "Bob Stone", "confidence": 0.7}), {(1, 2, "owes", 0.7, "[]")}),
    ],
)
def test_answers(spark, answer, expected):
    got = relations.relations(relations.parsed(answered(spark, [(1, 2, answer)]))).collect()
    assert {tuple(r) for r in got} == expected


def asked(spark):
    return answered(spark, [(1, 2, None)]).drop("answer").withColumns({"evidence": F.array(F.lit(5).cast("long")), "prompt": F.lit("What?")})


def tell(prompt, attempt):
    if attempt == 0:
        raise jobs.RetryAfter(1)
    return said(rel("Ann Lee", "writes to", "Bob Stone", 1.0))


def fail(questions):
    raise RuntimeError("no line")


def test_refresh(spark):
    path = shared.place(spark, "relations")
    ask = relations.asked_by(tell, f"{path}/answers", policy=jobs.Policy(sleep=lambda s: None))
    row = relations.refresh(spark, path, asked(spark), ask)
    assert (row["total"], row["processed"], row["created"], row["errors"], row["status"]) == (1, 1, 1, 0, "done")
    with pytest.raises(RuntimeError):
        relations.refresh(spark, path, asked(spark), fail)
    table, runs = Table(spark, f"{path}/relations", relations.RELATIONS), Table(spark, f"{path}/runs", relations.RUNS)
    assert [tuple(r) for r in table.read().collect()] == [(1, 2, "writes to", 1.0, "[5]")]  # the old ones stay
    assert sorted((r["status"], r["message"]) for r in runs.read().collect()) == [("crashed", "no line"), ("done", None)]
    held = lease.acquire(spark, f"{path}/lease", "other")
    with pytest.raises(relations.Busy):
        relations.refresh(spark, path, asked(spark), ask)
    held.release()
    assert relations.refresh(spark, path, asked(spark).limit(0), ask)["created"] == 0 and table.read().count() == 0


def test_questions_show_records_and_roles(spark):
    members = spark.createDataFrame([("d", i, e, r) for i in range(1, 11) for e, r in ((1, "buyer"), (2, "seller"))] + [("g", 3, 1, "owner"), ("g", 3, 2, None), ("d", 1, 3, "buyer")], "kind string, record_id long, entity_id long, role string")
    names = spark.createDataFrame(list(NAMES.items()), "entity_id long, name string")
    records = spark.createDataFrame([("d", i, None if i == 2 else f"Deed {i}", "1900" if i == 1 else "", "x" * 2000) for i in range(1, 11)] + [("g", 3, "Set", "", None)], "kind string, record_id long, title string, date string, description string")
    (q,) = relations.questions(members, names, records).collect()
    assert (q["source"], q["target"], q["evidence"]) == (1, 2, [1, 2, 3, 4, 5, 6, 7, 8])
    assert "[document #1] Deed 1 — 1900\n  A: buyer, B: seller\n  " + "x" * 1200 + "\n\n[document #2] document #2\n" in q["prompt"] and "x" * 1201 not in q["prompt"]
