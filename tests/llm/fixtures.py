"""A small table with the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random


def docs(spark, seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ta", "ve", "wi", "xo", "zé")]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 14))) + "." for _ in range(rng.randint(1, 8))]
        if i % 4 == 1:
            lines.insert(rng.randint(0, len(lines)), passage)
        rows.append((i, "\n".join(lines)))
    base = [t for _, t in rows]
    rows += [(n + i, base[i]) for i in range(0, 12, 2)]  # exact copies
    for i in range(5, 11):  # near copies
        words = base[i].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((n + 20 + i, " ".join(words)))
    rows += [(n + 50, None), (n + 51, ""), (n + 52, " \n\t "), (n + 53, "one"), (n + 54, "one two"), (n + 55, "a " * 60), (n + 56, "a " * 40), (n + 57, " ".join(rng.choice(vocabulary) for _ in range(6000)))]
    rows += [(None, base[3]), (7, base[7]), (7, base[7]), (8, "other text of a repeated id"), (n + 58, "x" * 5000)]
    extra = [(k, t, None if i % 3 else "en", "src", None if t is None else len(t), i, "clash", i * 2) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, k int, h string, name long")


def empty(spark):
    return docs(spark, n=12).limit(0)


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def key(d):
    return -(2**63) if d is None else d
