"""Conversation repair against a search that keeps whole audits, over rows that tests damage themselves."""

import hashlib
import random
import re
import zlib

import pytest

from folioworks.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        mine = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * (1 + (kind == 3))
    return out


def brute(rows):
    """The result of one conversation's damaged rows (turn, role, text); every state keeps its best (cost, audit, output)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        said = [c for c in text if BLANK.match(c)]
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    nexts = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    grown = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def better(to, state, new):
        if state not in to or new[:2] < to[state][:2]:
            to[state] = new

    def inserted(best):
        for _ in range(3):
            for q, (c, audit, out) in list(best.items()):
                better(best, grown[q], (c + 3, audit + "I", (*out, names[grown[q]] + ":")))
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        to, more = {}, 3 * (fault == "truncated")
        for q, (c, audit, out) in best.items():
            better(to, q, (c + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            if (q, role[:1]) in nexts:
                better(to, nexts[q, role[:1]], (c + more, audit + "K", (*out, f"{role}:{text}")))
            better(to, grown[q], (c + 3 + more, audit + "R", (*out, f"{names[grown[q]]}:{text}")))
        best = inserted(to)
    cost, audit, out = min(best[q] for q in ("", "a") if q in best)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    out = df.collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r[c] for c in NAMES) for r in out}


def made(seed, convs, longest=9):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randint(1, longest)):
            text = rng.choice([None, "", " \t", "Yes.", "No", "what?\n", "a longer\ntext! ", "trailing , \n", f"own {turn}.", f"own {turn} {conv}", "é…", "x" * 300 + "."])
            rows.append((conv, rng.choice([None, turn, turn, turn, turn + 3]), rng.choice([None, "", "system", "user", "user", "assistant", "assistant", "tool", "USER"]), text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [2, 7, conversations.CHUNK])
def test_repair(spark, chunk):
    rows = made(chunk, 150) + [(5, 1, "user", "Yes.")] * 4
    df = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], SCHEMA + ", h string, part int").repartition(5)
    assert result(conversations.repaired(df, chunk)) == {c: brute(x) for c, x in damaged(rows).items()}


def rows_of(spark, rows):
    return spark.createDataFrame([(c, t, r, x, False) for c, t, r, x in rows], SCHEMA + ", gone boolean").repartition(3)


@pytest.mark.parametrize("kind", ["clean", "nobody", "blank", "equal", "mixed"])
def test_one_conversation_over_many_chunks_and_tasks(spark, kind):
    rng = random.Random(kind)
    one = {
        "clean": lambda i: (i, ("user", "assistant")[i % 2], f"said {i}."),
        "nobody": lambda i: (i, "tool", f"said {i}."),  # runs from different vectors never meet
        "blank": lambda i: (None, " ", " "),
        "equal": lambda i: (None, "assistant", "again."),
        "mixed": lambda i: (i // 3, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "one.", "two", f"own {i}.", f"own {i}"])),
    }[kind]
    rows = [(8, *one(i)) for i in range(500)] + [(c, 0, "user", "short.") for c in (7, 9)]
    expected = {c: brute([r[1:] for r in rows if r[0] == c]) for c in (7, 8, 9)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(conversations.repair(rows_of(spark, rows), 16))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected


def test_runs_that_meet_need_no_pass():
    clean = bytes([4, 8] * 20)
    assert len({conversations.runs(clean)[v] for v in range(len(conversations.VECTORS))}) == 1
    assert len(set(conversations.runs(bytes([12] * 40)))) > 1  # rows of unknown roles forget nothing


def test_nothing_left_and_empty(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)
    assert result(conversations.repaired(df)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.repaired(df.limit(0)).count() == 0


def test_long_texts(spark):
    rows = [(1, 0, "user", "long " * 400_000), (1, 1, "assistant", "?" + " " * 1_000_000), (1, 2, "user", "\n" * 500_000)]
    assert result(conversations.repaired(spark.createDataFrame(rows, SCHEMA))) == {c: brute(x) for c, x in damaged(rows).items()}
