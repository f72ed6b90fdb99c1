"""The entity graph."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators.records import between
from folioworks.sources import shared
from folioworks.sources.archive import Archive


def memberships(a: Archive, types: tuple[str, ...] | None = None) -> DataFrame:
    """(kind, record_id, entity_id, role) of live standalone documents and live groups, of the given entity types."""
    links = shared.staged(a.document_entities, "links")  # a stage of distinct links, joins and types at once holds memory for each of its steps
    docs = links.join(a.standalone.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    groups = a.group_entities.join(a.live_groups.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    both = docs.select(F.lit("d").alias("kind"), F.col("document_id").alias("record_id"), "entity_id", "role")
    both = both.unionByName(groups.select(F.lit("g").alias("kind"), F.col("group_id").alias("record_id"), "entity_id", "role"))
    if types:
        both = both.join(a.entities.where(F.col("type").isin(*types)).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return both


def nodes(members: DataFrame) -> DataFrame:
    """A4: distinct records of each entity."""
    return members.groupBy("entity_id").agg(F.countDistinct("kind", "record_id").alias("doc_count"))


#: Entities of a record that are paired at once: a record of more is cut into blocks of about so many.
BLOCK = 1000


#: Pairs, and rows that are to be paired, of a task: tasks follow what there is, and none grows with it.
PAIRS = 500_000


#: Pairs that are exchanged at once by `shared_first`: more are dealt into slices, each of which is done before the next.
SLICE = 100_000_000


def _tasks(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PAIRS))


def _counted(members: DataFrame) -> DataFrame:
    """(kind, record_id, entity_id, n): each record's entities, as often as they have roles."""
    return members.groupBy("kind", "record_id", "entity_id").agg(F.count("*").alias("n"))


def _blocked(each: DataFrame, block: int) -> DataFrame:
    hubs = each.groupBy("kind", "record_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    rows = each.join(hubs, ["kind", "record_id"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("entity_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = rows.select("kind", "record_id", "entity_id", "n", "own", other)
    left = met.where("own <= other").select("kind", "record_id", "entity_id", "n", F.col("own").alias("i"), F.col("other").alias("j"), F.lit("left").alias("side"))
    return left.unionByName(met.where("other <= own").select("kind", "record_id", "entity_id", "n", F.col("other").alias("i"), F.col("own").alias("j"), F.lit("right").alias("side")))


def blocked(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(kind, record_id, entity_id, n, i, j, side): each record's entities, as often as they have roles (n), in the
    pairs of blocks that they are compared in.

    A record of up to `block` entities is one block. Of one with more, an entity's block meets each other block once,
    so no key (kind, record_id, i, j) makes more than about block x block pairs, and no record is gathered.
    """
    return _blocked(_counted(members), block)


def _paired(members: DataFrame, block: int) -> tuple[DataFrame, int]:
    """`paired`, and the tasks that its rows are to be dealt over by pair. Members are counted and staged when this is called."""
    each = shared.staged(_counted(members), "members")
    sizes = each.groupBy("kind", "record_id").agg(F.count("*").alias("m"))
    pairs, rows, most = sizes.agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1)), F.lit(0)), F.coalesce(F.sum(F.col("m") * F.ceil(F.col("m") / block)), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    if most <= block:  # no hub: each record is one block
        sides, key = (each, each), ["kind", "record_id"]
    else:
        all_, key = _blocked(each, block), ["kind", "record_id", "i", "j"]
        sides = tuple(all_.where(F.col("side") == side) for side in ("left", "right"))
    left, right = (x.select(*key, F.col("entity_id").alias(name), F.col("n").alias(f"n_{name}")).repartition(_tasks(each, rows), *key) for x, name in zip(sides, "ab"))
    both = left.join(right, key).where("a < b" if most <= block else "i < j or a < b")
    out = both.select("kind", "record_id", F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), (F.col("n_a") * F.col("n_b")).alias("n"))
    return out, _tasks(each, pairs // 2)


def paired(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(kind, record_id, source, target, n): the pairs of each record's entities, n their combinations of roles."""
    return _paired(members, block)[0]


def _by_pair(members: DataFrame) -> DataFrame:
    """`paired`, dealt by pair: what is grouped by pair isn't exchanged again."""
    rows, tasks = _paired(members, BLOCK)
    return rows.repartition(tasks, "source", "target")


def edges(members: DataFrame, min_weight: int = 1) -> DataFrame:
    """Pairs within a record; the threshold holds for documents and groups apart, then weights add up.

    weight counts combinations of roles, shared_records distinct records.
    """
    each = _by_pair(members).groupBy("kind", "source", "target").agg(F.sum("n").alias("weight"), F.count("*").alias("shared_records")).where(F.col("weight") >= min_weight)
    return each.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.sum("shared_records").alias("shared_records"))


def counted(members: DataFrame, outer: bool = False) -> DataFrame:
    """(kind, record_id, entity_id, n), staged: each record's entities, as often as they have roles."""
    return shared.staged(_counted(members), "members", outer)


def shared_first(each: DataFrame, least: int, most: int, block: int = BLOCK) -> Iterator[DataFrame]:
    """(source, target, evidence, kinds) of pairs with at least so many combinations of roles in their records:
    ids and kinds of the first records, documents before groups, at most so many. A table for each slice of the pairs of `counted` members.

    A record's entities (of a hub, those of two blocks) are one row, which is unfolded into the pairs of a slice; these are
    exchanged once, with their counts. So disk follows SLICE and the number of members, not the number of pairs.
    """
    with shared.cleaned(each.sparkSession):
        sizes = each.groupBy("kind", "record_id").agg(F.count("*").alias("m"))
        pairs, largest = sizes.agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0)).cast("long"), F.coalesce(F.max("m"), F.lit(0))).first()
    tasks, one = _tasks(each, pairs), F.struct("entity_id", "n")
    if largest <= block:  # no hub: each record is one block
        key, ys, meet = ["kind", "record_id"], "xs", "x.entity_id < y.entity_id"
        sets = each.repartition(tasks, *key).groupBy(*key).agg(F.collect_list(one).alias("xs"))
    else:
        key, ys, meet = ["kind", "record_id", "i", "j"], "ys", "i < j or x.entity_id < y.entity_id"
        sides = [F.collect_list(F.when(F.col("side") == side, one)).alias(name) for side, name in (("left", "xs"), ("right", "ys"))]
        sets = _blocked(each, block).repartition(tasks, *key).groupBy(*key).agg(*sides)
    sets = shared.staged(sets, "sets")
    slices = max(1, -(-pairs // SLICE))
    met = sets.withColumn("x", F.explode("xs")).withColumn("y", F.explode(ys)).where(meet)
    met = met.select("kind", "record_id", F.least("x.entity_id", "y.entity_id").alias("source"), F.greatest("x.entity_id", "y.entity_id").alias("target"), (F.col("x.n") * F.col("y.n")).alias("n"))
    ordered = Window.partitionBy("source", "target").orderBy("kind", "record_id")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for number in range(slices):
        mine = met.where(F.pmod(F.xxhash64("source", "target"), F.lit(slices)) == number).repartition(_tasks(each, pairs // slices), "source", "target")
        ranked = mine.withColumns({"all": F.sum("n").over(whole), "rank": F.row_number().over(ordered)}).where((F.col("all") >= least) & (F.col("rank") <= most))
        first = ranked.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("kind", "record_id"))).alias("x"))
        yield first.select("source", "target", F.col("x.record_id").alias("evidence"), F.col("x.kind").alias("kinds"))


def capped(nodes_: DataFrame, edges_: DataFrame, most: int = 400) -> tuple[DataFrame, DataFrame]:
    """The largest nodes, and the edges with both ends among them."""
    kept = nodes_.orderBy(F.desc("doc_count"), "entity_id").limit(most)
    ids = kept.select("entity_id")
    out = edges_.join(ids.select(F.col("entity_id").alias("source")), "source", "left_semi")
    return kept, out.join(ids.select(F.col("entity_id").alias("target")), "target", "left_semi")


def seed_scope(a: Archive, document_id: int) -> DataFrame:
    """Live standalone documents that share an entity with the seed."""
    own = a.document_entities.where(F.col("document_id") == document_id).select("entity_id").distinct()
    near = a.document_entities.join(own, "entity_id", "left_semi").select(F.col("document_id").alias("id")).distinct()
    return a.standalone.join(near, "id", "left_semi").select("id", "title")


def highlighted(nodes_: DataFrame, edges_: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """Nodes whose name contains the text, and their neighbours."""
    named = nodes_.join(names, "entity_id").where(F.contains(F.lower("name"), F.lit(text.lower()))).select("entity_id")
    out = edges_.join(named.select(F.col("entity_id").alias("source")), "source", "left_semi").select(F.col("target").alias("entity_id"))
    back = edges_.join(named.select(F.col("entity_id").alias("target")), "target", "left_semi").select(F.col("source").alias("entity_id"))
    all_ = named.withColumn("matched", F.lit(1)).unionByName(out.union(back).withColumn("matched", F.lit(0)))
    return all_.groupBy("entity_id").agg(F.max("matched").alias("matched"))


def parallel(edges_: DataFrame) -> DataFrame:
    """Each edge's place among those of its unordered pair, and their number."""
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target"))
    return edges_.withColumns({"edge_index": F.row_number().over(pair.orderBy("verb", "source")) - 1, "edge_total": F.count("*").over(pair)})


def evidence(members: DataFrame, pairs: DataFrame, most: int = 8) -> DataFrame:
    """Of each pair, at most so many records, documents before groups.

    Pairs are made within each record, as `edges` makes them, so rows follow the pairs there are
    and not an entity's edges times its records; those that no edge has go, and the window's
    limit is applied before its exchange.
    """
    both = _by_pair(members).join(pairs.select("source", "target"), ["source", "target"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("source", "target").orderBy("kind", "record_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most).select("source", "target", "kind", "record_id", "rank")


def pair_records(members: DataFrame, least: int = 2) -> DataFrame:
    """Of each pair the records they share, with repeats by role, as two ordered lists; pairs with at least so many."""
    both = _by_pair(members)

    def listed(kind: str):
        return F.array_sort(F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.array_repeat("record_id", F.col("n").cast("int"))))))

    return both.groupBy("source", "target").agg(listed("d").alias("documents"), listed("g").alias("groups")).where(F.size("documents") + F.size("groups") >= least)


def scope(a: Archive, *, entity_id: int | None = None, tag: str | None = None, document_id: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """G1: (kind, record_id) of live standalone documents and groups that meet all given tests; a group by its own entities or its pages'. Tags and seeds are of documents alone."""
    dated = between(exprs.effective_date(F.col("date_depicted"), F.col("date_range_start")), since, until)
    docs, groups = (x.where(dated).select("id") for x in (a.standalone, a.live_groups))
    if entity_id is not None:
        mine = a.document_entities.where(F.col("entity_id") == entity_id).select(F.col("document_id").alias("id"))
        docs = docs.join(mine, "id", "left_semi")
        pages = a.documents.where("group_id is not null").join(mine, "id", "left_semi").select(F.col("group_id").alias("id"))
        own = a.group_entities.where(F.col("entity_id") == entity_id).select(F.col("group_id").alias("id"))
        groups = groups.join(pages.union(own), "id", "left_semi")
    if tag is not None:
        docs = docs.join(a.document_tags.where(F.col("tag") == tag).select(F.col("document_id").alias("id")), "id", "left_semi")
    if document_id is not None:
        docs = docs.join(seed_scope(a, document_id).select("id"), "id", "left_semi")
    return docs.select(F.lit("d").alias("kind"), F.col("id").alias("record_id")).unionByName(groups.select(F.lit("g").alias("kind"), F.col("id").alias("record_id")))
