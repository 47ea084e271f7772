"""Graphs over package parts and names: closure and connected components.

Both loop until nothing changes. Each round's result is cut off with a reliable
checkpoint, so a lost executor costs one round and not the whole loop.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from galley.registries import MAX_FONT_ALIASES


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    The session names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, may do without.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="galley-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder; Spark removes the files with the frame
    when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def part_closure(roots: DataFrame, links: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts reachable from the root parts, and dangling links on the way.

    ``roots`` has ``pkg_id, part``; ``links`` ``pkg_id, base_part, target_part``
    (internal ones); ``parts`` ``pkg_id, part``. Every part is visited once, so
    cycles end by themselves.
    """
    known = parts.select("pkg_id", "part").distinct()
    edges = links.select("pkg_id", F.col("base_part").alias("part"), "target_part").distinct()
    live = settled(
        edges.join(
            known.withColumnRenamed("part", "target_part"), ["pkg_id", "target_part"], "left_semi"
        )
    )
    front = settled(roots.select("pkg_id", "part").distinct().join(known, ["pkg_id", "part"], "left_semi"))
    reached = front
    while not front.isEmpty():
        front = settled(
            front.join(live, ["pkg_id", "part"])
            .select("pkg_id", F.col("target_part").alias("part"))
            .distinct()
            .join(reached, ["pkg_id", "part"], "left_anti")
        )
        reached = reached.unionByName(front)
    dangling = (
        edges.join(reached, ["pkg_id", "part"], "left_semi")
        .join(known.withColumnRenamed("part", "target_part"), ["pkg_id", "target_part"], "left_anti")
        .withColumnRenamed("part", "base_part")
    )
    return reached, dangling


def components(edges: DataFrame, keys=("pkg_id",)) -> DataFrame:
    """Smallest member of the connected component of every node.

    ``edges`` has the keys and ``a, b``. Rounds alternate two star steps: every
    node links its larger neighbours, then its smaller ones, to the smallest it
    knows. Paths shrink geometrically, a hub only ever sends one minimum, and
    the graph never gets more edges than it had. Graphs of one key that are all
    stars leave the rounds; without keys there is one graph.
    """
    keys = list(keys)
    node = [*keys, "a"]

    def both_ways(e: DataFrame) -> DataFrame:
        back = e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
        return e.select(*keys, "a", "b").unionByName(back)

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = both_ways(e)
        if not large:
            around = around.filter("b < a")
        low = around.groupBy(*node).agg(F.least(F.min("b"), F.col("a")).alias("low"))
        joined = around.join(low, node)
        kept = joined.filter("b > a") if large else joined
        linked = kept.select(*keys, F.col("b").alias("x"), "low")
        if not large:
            linked = linked.unionByName(low.select(*keys, F.col("a").alias("x"), "low"))
        return linked.filter("x <> low").select(*keys, F.col("x").alias("a"), F.col("low").alias("b")).distinct()

    def open_nodes(e: DataFrame) -> DataFrame:
        """Nodes that still have two links down, or one down and one up."""
        ends = e.select(*keys, "a", F.lit(1).alias("down"), F.lit(0).alias("up"))
        ends = ends.unionByName(e.select(*keys, F.col("b").alias("a"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        met = ends.groupBy(*node).agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        return met.filter((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))

    given = settled(edges.select(*keys, "a", "b").distinct())
    proper = F.coalesce(F.col("a") != F.col("b"), F.lit(False))
    for k in keys:
        proper = proper & F.col(k).isNotNull()
    current, stars = given.filter(proper), []
    while True:
        current = settled(star(star(current, True), False))
        left = open_nodes(current)
        left = settled(left.select(*keys).distinct() if keys else left)
        if left.isEmpty():
            stars.append(current)
            break
        if keys:
            stars.append(current.join(left, keys, "left_anti"))
            current = settled(current.join(left, keys, "left_semi"))
    found = reduce(DataFrame.unionByName, stars)
    label = found.select(*node, F.col("b").alias("root"))
    label = label.unionByName(found.select(*keys, F.col("b").alias("a"), F.col("b").alias("root")).distinct())
    alone = both_ways(given.filter(~proper)).select(*node).distinct().join(label, node, "left_anti")
    return label.unionByName(alone.withColumn("root", F.col("a"))).withColumnRenamed("a", "node")


#: Links that one key's graph may have to be taken as one row; those with more go through the rounds of :func:`components`.
LINKS_PER_ROW = 1 << 17
_ROWS_AT_ONCE = 1 << 15


def font_aliases(edges: DataFrame, shown: DataFrame, keys=("pkg_id",)) -> DataFrame:
    """Other names of every font, at most 64, in name order.

    ``edges`` links name keys (``a, b``); ``shown`` has the keys, ``node``,
    ``name`` and ``fold`` (its case-folded form). Only the first 65 names of a
    component can appear in any list, so each name keeps those without itself:
    no pairs are formed. The graph of one key is one package's font table, so it
    is one row, and links and names are moved once, by key. Keys with more links
    than such a row may hold are labelled in rounds and never gathered.
    """
    keys = list(keys)
    large = settled(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LINKS_PER_ROW).select(*keys))
    if large.isEmpty():
        return _aliases_by_row(edges, shown, keys)
    rest = lambda df: df.join(large, keys, "left_anti")
    mine = lambda df: df.join(large, keys, "left_semi")
    return _aliases_by_row(rest(edges), rest(shown), keys).unionByName(_aliases_by_rounds(mine(edges), mine(shown), keys))


def _linked(edges: list[tuple], shown: list[tuple]) -> Iterator[list[tuple]]:
    """``(node, name)`` of the components of one graph that have several nodes, each in name order."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = root(a), root(b)
            if low != high:
                parent[high] = low
    members: dict = {}
    for node, name, fold in shown:
        if node in parent:
            members.setdefault(root(node), []).append((fold is not None, fold, name is not None, name, node))
    for rows in members.values():
        if len({r[4] for r in rows}) > 1:
            rows.sort(key=lambda r: (r[0], r[1] if r[0] else "", r[2], r[3] if r[2] else ""))
            yield [(r[4], r[3]) for r in rows]


def _aliases_by_row(edges: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    graphs = edges.groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    named = shown.groupBy(*keys).agg(F.collect_list(F.struct("node", "name", "fold")).alias("shown"))
    given = graphs.join(named, keys)
    fields = {f.name: f.dataType for f in shown.schema.fields}
    members = ArrayType(StructType([StructField("node", fields["node"]), StructField("name", fields["name"])]))
    out = StructType([*[given.schema[k] for k in keys], StructField("members", members)])
    schema = to_arrow_schema(out)

    def items(column: pa.ListArray) -> tuple[list[int], list[tuple]]:
        """Offsets of a list column, and its entries one after the other."""
        offsets = column.offsets.to_pylist()
        flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
        return [o - offsets[0] for o in offsets], list(zip(*(x.to_pylist() for x in flat.flatten())))

    def gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
        (e_at, e), (s_at, s) = items(batch["edges"]), items(batch["shown"])
        found = [(i, rows) for i in range(batch.num_rows) for rows in _linked(e[e_at[i] : e_at[i + 1]], s[s_at[i] : s_at[i + 1]])]
        of = pa.array([i for i, _ in found], pa.int32())
        ends = pa.array(list(accumulate((len(rows) for _, rows in found), initial=0)), pa.int32())
        kind = schema.field("members").type.value_type
        parts = [pa.array([r[k] for _, rows in found for r in rows], kind.field(k).type) for k in (0, 1)]
        lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=[kind.field(0), kind.field(1)]), type=schema.field("members").type)
        return pa.RecordBatch.from_arrays([*[batch[k].take(of) for k in keys], lists], schema=schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [a + b for a, b in zip(batch["edges"].value_lengths().to_pylist(), batch["shown"].value_lengths().to_pylist())]
            begin, held = 0, 0
            for i, size in enumerate(sizes, 1):
                held += size
                if held >= _ROWS_AT_ONCE or i == len(sizes):
                    yield gathered(batch.slice(begin, i - begin))
                    begin, held = i, 0

    rows = given.mapInArrow(gather, out)
    head = F.slice("members", 1, MAX_FONT_ALIASES + 1)
    others = F.filter("head", lambda h: h["node"] != F.col("m.node"))
    names = F.slice(F.transform(others, lambda h: h["name"]), 1, MAX_FONT_ALIASES)
    each = rows.select(*keys, head.alias("head"), F.explode("members").alias("m"))
    return each.select(*keys, "m.node", "m.name", names.alias("aliases")).filter(F.size("aliases") > 0)


def _aliases_by_rounds(edges: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    labelled = settled(components(edges, keys).join(shown, [*keys, "node"]))
    group = [*keys, "root"]
    by_name = Window.partitionBy(*group).orderBy("fold", "name")
    head = (
        labelled.withColumn("place", F.row_number().over(by_name))
        .filter(F.col("place") <= MAX_FONT_ALIASES + 1)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("place", "node", "name"))).alias("head"))
    )
    others = F.filter("head", lambda h: h["node"] != F.col("node"))
    names = F.slice(F.transform(others, lambda h: h["name"]), 1, MAX_FONT_ALIASES)
    return (
        labelled.join(head, group)
        .select(*keys, "node", "name", names.alias("aliases"))
        .filter(F.size("aliases") > 0)
    )
