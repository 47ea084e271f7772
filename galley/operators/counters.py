"""Heading counters: 1, 1.1, 1.1.1 … over document order.

Counting is a scan, but not a single-task one. Rows are cut into blocks of
consecutive positions; each block is scanned on its own, its summary row is
scanned across blocks, and the carried state is joined back. A part that holds
most of the data is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from galley.functions.numerals import fitted, typed_shape
from galley.operators.graph import settled
from galley.registries import BODY_PART

LEVELS = range(9)
BLOCK = 65_536


def _max(*columns: Column) -> Column:
    columns = [c for c in columns]
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def _reset(last: dict[int, Column], level: int) -> Column:
    """Last position of a shallower heading, NULL when there is none."""
    shallower = [last[j] for j in range(level)]
    return _max(*shallower) if shallower else F.lit(None).cast("bigint")


def _present(last: dict[int, Column], level: int) -> Column:
    """A level has a live counter: seen since the last shallower heading."""
    reset = F.coalesce(_reset(last, level), F.lit(-1))
    return F.coalesce(last[level], F.lit(-1)) > reset


def _case(level: Column, values: dict[int, Column]) -> Column:
    return reduce(lambda acc, k: F.when(level == k, values[k]).otherwise(acc), LEVELS, F.lit(None))


def heading_counters(rows: DataFrame, keys=("pkg_id", "part"), block: int = BLOCK) -> DataFrame:
    """Add ``value``, ``path`` and ``ok`` to heading rows.

    ``rows`` has the keys, ``ord`` (0-based position, unique per key), ``level``
    (0-8), ``start`` and ``typed`` (typed first number, or NULL). A shallower
    heading restarts the deeper levels. The first level-0 row takes its typed
    number. A row whose parents are not all counted yet has ``ok`` false: it
    shows its start, and neither matches nor counts on.
    """
    keys = list(keys)
    # The input is evaluated once; only a few numbers of each row are scanned, and
    # their results are joined back to it.
    rows = settled(rows)
    slim = rows.select(*keys, "ord", "level", "start", "typed")
    whole = F.when(F.col("start") > 0, F.col("start")).otherwise(F.lit(1)).cast("bigint")
    seeded = F.when(F.col("level") == 0, F.coalesce("typed", whole)).otherwise(whole)
    base = (
        slim.withColumn("_ord", F.col("ord"))
        .withColumn("ord", F.col("ord").cast("bigint"))
        .withColumn("_st", whole)
        .withColumn("_seed", seeded.cast("bigint"))
        .withColumn("_blk", F.floor(F.col("ord") / block))
    )
    level = F.col("level")
    inside = Window.partitionBy(*keys, "_blk").orderBy("ord")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    at = lambda k: level == k

    local = base.select(
        "*",
        *[F.max(F.when(at(k), F.col("ord"))).over(before).alias(f"_l{k}") for k in LEVELS],
        *[F.count(F.when(at(k), F.lit(1))).over(so_far).alias(f"_n{k}") for k in LEVELS],
    )
    last = {k: F.col(f"_l{k}") for k in LEVELS}
    # Rows that follow a shallower heading of the same block belong to a group
    # that starts inside the block; its first row fixes the offset of the count.
    closed_first = {
        k: at(k)
        & _reset(last, k).isNotNull()
        & (last[k].isNull() | (last[k] < _reset(last, k)))
        for k in LEVELS
    }
    open_first = {k: at(k) & _reset(last, k).isNull() & last[k].isNull() for k in LEVELS}
    offset = {k: F.when(closed_first[k], F.col("_seed") - F.col(f"_n{k}")) for k in LEVELS}
    local = local.select(
        "*",
        *[F.last(offset[k], ignorenulls=True).over(so_far).alias(f"_c{k}") for k in LEVELS],
        *[F.when(open_first[k], F.col("_seed")).alias(f"_o{k}") for k in LEVELS],
    )

    summary = local.groupBy(*keys, "_blk").agg(
        *[F.max(F.when(at(k), F.col("ord"))).alias(f"sl{k}") for k in LEVELS],
        *[F.max(f"_n{k}").alias(f"sn{k}") for k in LEVELS],
        *[F.max_by(f"_c{k}", "ord").alias(f"sc{k}") for k in LEVELS],
        *[F.max(f"_o{k}").alias(f"so{k}") for k in LEVELS],
    )
    blocks = Window.partitionBy(*keys).orderBy("_blk")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        "_blk",
        *[F.col(f"s{x}{k}") for x in "co" for k in LEVELS],
        *[F.max(f"sl{k}").over(earlier).alias(f"pl{k}") for k in LEVELS],
        *[F.coalesce(F.sum(f"sn{k}").over(earlier), F.lit(0)).alias(f"pn{k}") for k in LEVELS],
    )
    prior = {k: F.col(f"pl{k}") for k in LEVELS}
    opened = {
        k: F.when(~_present(prior, k), F.col(f"so{k}") - 1 - F.col(f"pn{k}")) for k in LEVELS
    }
    carried = carried.select(
        "*",
        *[
            F.coalesce(F.col(f"sc{k}") - F.col(f"pn{k}"), opened[k]).alias(f"ev{k}")
            for k in LEVELS
        ],
    ).select(
        *keys,
        "_blk",
        *[F.col(f"p{x}{k}") for x in "ln" for k in LEVELS],
        *[
            F.coalesce(
                opened[k], F.last(f"ev{k}", ignorenulls=True).over(earlier)
            ).alias(f"pb{k}")
            for k in LEVELS
        ],
    )

    joined = local.join(carried, [*keys, "_blk"])
    now = {k: F.coalesce(F.col(f"_l{k}"), F.col(f"pl{k}")) for k in LEVELS}
    counter = {
        k: F.coalesce(F.col(f"_c{k}") - F.col(f"pn{k}"), F.col(f"pb{k}"))
        + F.col(f"pn{k}")
        + F.col(f"_n{k}")
        for k in LEVELS
    }
    parents = {
        k: reduce(lambda a, b: a & b, [_present(now, j) for j in range(k)], F.lit(True))
        for k in LEVELS
    }
    ok = _case(level, parents)
    path = _case(level, {k: F.array(*[counter[j] for j in range(k + 1)]) for k in LEVELS})
    counted = joined.select(
        *keys,
        F.col("_ord").alias("ord"),
        ok.alias("ok"),
        F.when(ok, _case(level, counter)).otherwise(F.col("_st")).alias("value"),
        F.when(ok, path).alias("path"),
    )
    return rows.join(counted, [*keys, "ord"]).select(*rows.columns, "ok", "value", "path")


def typed_numbers(paragraphs: DataFrame, level: str = "level") -> DataFrame:
    """Add the typed prefix of plain heading paragraphs: ``prefix`` and
    ``typed``, its number when it is a single one."""
    shaped = paragraphs.withColumn("shape", F.when(F.col("plain"), typed_shape(F.col("text"))))
    return fitted_numbers(shaped, level).drop("shape")


def fitted_numbers(shaped: DataFrame, level: str = "level") -> DataFrame:
    """:func:`typed_numbers` of paragraphs that have the typed number's ``shape`` instead of a text."""
    out = shaped.withColumn("prefix", fitted(F.col("shape"), F.col(level)))
    single = F.when(F.size("prefix.numbers") == 1, F.col("prefix.numbers")[0])
    return out.withColumn("typed", single.cast("bigint"))


def matched_prefixes(counted: DataFrame) -> DataFrame:
    """Mark typed numbers that repeat the counter."""
    numbers = F.transform("prefix.numbers", lambda n: n.cast("bigint"))
    return counted.withColumn("matched", F.coalesce(F.col("ok") & (numbers == F.col("path")), F.lit(False)))


def redundant_prefixes(counted: DataFrame) -> DataFrame:
    """Mark typed numbers that repeat the counter and strip them from the text."""
    return matched_prefixes(counted).withColumn(
        "stripped",
        F.when(
            F.col("matched"), F.substring("text", F.col("prefix.consumed") + 1, F.length("text"))
        ).otherwise(F.col("text")),
    )


def seeded_starts(matched: DataFrame, keys=("pkg_id",)) -> DataFrame:
    """Keys, ``seed, ord``: the start value set by a typed first heading of the body, and where it stands.

    Only the first level-0 heading can seed the counter, and only when its
    typed number was accepted.
    """
    top = matched.filter((F.col("level") == 0) & (F.col("part") == BODY_PART))
    first = F.min_by(F.struct("matched", "typed", "ord"), "ord")
    return (
        top.groupBy(*keys)
        .agg(first.alias("f"))
        .filter("f.matched AND f.typed IS NOT NULL")
        .select(*keys, F.col("f.typed").alias("seed"), F.col("f.ord").alias("ord"))
    )


def list_start(matched: DataFrame) -> DataFrame:
    """``pkg_id, seed`` of :func:`seeded_starts`."""
    return seeded_starts(matched).drop("ord")


def dual_counters(headings: DataFrame, keys=("pkg_id", "part"), block: int = BLOCK) -> DataFrame:
    """Prefix check under demotion: typed numbers follow the original levels,
    printed numbers the new ones.

    ``headings`` has ``level`` (original), ``new_level``, ``start``, ``plain``
    and ``text``.
    """
    original = redundant_prefixes(heading_counters(typed_numbers(headings), keys, block))
    original = original.withColumnsRenamed({"value": "old_value", "path": "old_path", "ok": "old_ok"})
    shifted = original.withColumnRenamed("level", "old_level").withColumnRenamed("new_level", "level")
    shifted = shifted.withColumnRenamed("typed", "old_typed").withColumn(
        "typed", F.lit(None).cast("bigint")
    )
    return heading_counters(shifted, keys, block)
