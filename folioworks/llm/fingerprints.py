"""Op 2, homomorphic multiset fingerprints of documents; DataFrame operations only.

A text is the multiset of its paragraphs (what stands between line feeds, each with the line
feed that closes it). Every paragraph is hashed to a wide vector; a document's fingerprint is
the sum of its paragraphs' vectors, coordinate by coordinate modulo 2^32. A vector's first
coordinates are uniform, by which equal multisets are told. The others count: each of the
paragraph's sentences (cut after full stops) raises each counter by 0 or 1; the counters'
differences estimate how much two texts share, also where a change lies inside a paragraph.
The paragraphs' order doesn't matter; `inserted` and `deleted` update a fingerprint without
the whole text.

The next document is looked up in slices of consecutive keys. Rows are sorted by ranges whose
bounds come from a sample of the keys with the text's hash and the row's number, so they are even
whatever the ids are, null and repeated ids and equal rows too; a range is cut into slices of SLICE
rows, whatever its size, and places are fixed in a staged table before anything depends on them.
The first row of each slice is also a guest of the slice before it.

Results: null and empty texts have the fingerprint of zeros and are alike by 1; rows that
repeat a doc_id are documents of their own, ordered by a hash of their texts; the next of a
single document is itself; other columns are ignored; an empty table gives an empty result.
Texts are taken whole; a text of 2^32 sentences or more, of which a counter would begin anew,
is longer than a string can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm import common

#: Hashes of which each gives two uniform coordinates.
EXACT = 4
#: Sums of two counters each; a hash serves 32.
PACKED = 63
#: Documents of a slice, within which the next document is looked up, and of a task that sorts slices.
SLICE, ROWS = 1000, 20_000
_LOW32 = 2**32 - 1
_FIELDS = 1 | 1 << 32


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=\n)", -1), lambda x: x != "")


def sentences(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, r"(?<=[.])(?!\n)", -1), lambda x: x != "")


def elements(text: Column) -> Column:
    """A text's sentences (s); the first of each paragraph has the whole paragraph (p) with it."""
    each = F.transform(paragraphs(text), lambda p: F.transform(sentences(p), lambda s, i: F.struct(s.alias("s"), F.when(i == 0, p).alias("p"))))
    return F.flatten(each)


def vector(element: Column) -> list[Column]:
    """What an element adds to each coordinate: its paragraph's uniform ones, its own to the counters."""
    out = []
    for i in range(EXACT):
        h = F.xxhash64(F.lit(i), element["p"])
        out += [F.when(element["p"].isNotNull(), x).otherwise(0) for x in (h.bitwiseAND(F.lit(_LOW32)), F.shiftrightunsigned(h, 32))]
    for i in range(PACKED):
        out.append(F.shiftrightunsigned(F.xxhash64(F.lit(EXACT + i // 32), element["s"]), i % 32).bitwiseAND(F.lit(_FIELDS)))
    return out


def _both(x: Column, y: Column, sign: int) -> Column:
    """x plus or minus y in each half by itself, modulo 2^32."""
    low = (x.bitwiseAND(F.lit(_LOW32)) + sign * y.bitwiseAND(F.lit(_LOW32))).bitwiseAND(F.lit(_LOW32))
    high = F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32)
    return F.shiftleft(high, 32).bitwiseOR(low)


def _reduced(v: Column) -> Column:
    """The uniform coordinates modulo 2^32."""
    return F.transform(v, lambda x, i: F.when(i < 2 * EXACT, x.bitwiseAND(F.lit(_LOW32))).otherwise(x))


def inserted(fingerprint: Column, other: Column) -> Column:
    """The fingerprint vector of both multisets together."""
    return _reduced(F.zip_with(fingerprint, other, lambda x, y: _both(x, y, 1)))


def deleted(fingerprint: Column, other: Column) -> Column:
    """The fingerprint vector without the other's elements, which it must hold."""
    return _reduced(F.zip_with(fingerprint, other, lambda x, y: _both(x, y, -1)))


def text_of(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x, i: F.when(i < 2 * EXACT, F.lpad(F.lower(F.hex(x)), 8, "0")).otherwise(F.lpad(F.lower(F.hex(x)), 16, "0"))), "")


def likeness(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """Estimated Jaccard similarity of multisets of n_a and n_b sentences.

    Twice a counters' difference, less the difference of the sizes, is a sum of one random
    sign for each element that only one multiset has; its mean square is their number.
    """

    def counters(v: Column) -> Column:
        return F.flatten(F.transform(F.slice(v, 2 * EXACT + 1, PACKED), lambda x: F.array(x.bitwiseAND(F.lit(_LOW32)), F.shiftrightunsigned(x, 32))))

    squares = F.aggregate(F.zip_with(counters(a), counters(b), lambda x, y: F.pow((2 * (x - y) - (n_a - n_b)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    apart, total = squares / (2 * PACKED), n_a + n_b
    return F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (total - apart) / (total + apart))))


def _sliced(docs: DataFrame) -> DataFrame:
    """Rows with `slice`, SLICE consecutive keys at most, and in each slice a guest: the first row of the slice that follows in descending order."""
    rows = common.keyed(docs).withColumn("copy", F.monotonically_increasing_id())
    order = [F.desc("k"), F.desc("h"), F.asc("copy")]
    ranges = max(1, docs.count() // ROWS)
    rows = common.staged(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges")
    # a row's number has its range in the upper bits, and its place in the range below
    place = F.col("at").bitwiseAND(F.lit(2**33 - 1))
    rows = rows.withColumns({"range": F.shiftright("at", 33), "slice": F.col("at") - place + F.floor(place / SLICE), "head": place % SLICE == 0})
    # one row for each range: its first row is a guest of the last slice of the range before, the first range's of the last of all
    ends = rows.groupBy("range").agg(F.max("slice").alias("last"))
    before = F.coalesce(F.lag("last").over(Window.orderBy("range")), F.max("last").over(Window.partitionBy()))
    ends = ends.select("range", before.alias("before"))
    columns = [c for c in rows.columns if c not in ("slice", "at", "range", "head")]
    heads = rows.where("head").join(ends, "range")
    guests = heads.select(F.when(F.col("slice") > F.shiftleft("range", 33), F.col("slice") - 1).otherwise(F.col("before")).alias("slice"), *columns, F.lit(True).alias("guest"))
    return rows.select("slice", *columns, F.lit(False).alias("guest")).unionByName(guests)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = _sliced(docs)
    order = Window.partitionBy("slice").orderBy("guest", F.desc("k"), F.desc("h"), "copy")
    chars = F.length("text")
    third = F.floor(chars / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, chars - third)"), F.expr("substring(next, 1, third)"))
    rows = rows.withColumns({"next": F.lead("text").over(order), "chars": chars, "third": third})
    rows = rows.withColumn("edited", F.coalesce(edited, F.lit("")))
    key = ["slice", "guest", "k", "h", "copy"]
    both = rows.select(*key, "chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("of")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("of")))).alias("e"))
    parts = both.select(*key, "chars", "edited_sha256", "e.kind", F.explode_outer(elements(F.col("e.of"))).alias("element"))
    found = F.col("element.s").isNotNull()
    sums = [F.sum(F.when(found, v).otherwise(0)).alias(f"v{i}") for i, v in enumerate(vector(F.col("element")))]
    summed = parts.groupBy(*key, "chars", "edited_sha256", "kind").agg(F.count("element.s").alias("n"), *sums)
    width = 2 * EXACT + PACKED
    summed = summed.select(*key, "chars", "edited_sha256", "kind", F.struct(F.col("n"), _reduced(F.array(*(F.col(f"v{i}") for i in range(width)))).alias("v")).alias("f"))
    one = summed.groupBy(*key, "chars", "edited_sha256").agg(*(F.max(F.when(F.col("kind") == i, F.col("f"))).alias(c) for i, c in enumerate(("own", "changed"))))
    one = one.withColumn("following", F.lead("own").over(order)).where("not guest")

    def near(other: str) -> Column:
        return likeness(F.col("own.v"), F.col("own.n"), F.col(f"{other}.v"), F.col(f"{other}.n"))

    return one.select(
        common.doc_id(), F.col("chars").cast("long").alias("n_chars"), "edited_sha256", text_of(F.col("own.v")).alias("fingerprint"),
        text_of(F.col("changed.v")).alias("edited_fingerprint"), near("changed").alias("near_edited"), near("following").alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
