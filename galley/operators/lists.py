"""Body lists of a target: effective references, fresh ids, remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from galley.functions.props import BAG, override
from galley.functions.units import lenient_int


def effective_reference(paragraphs: DataFrame, resolved: DataFrame, defaults: DataFrame) -> DataFrame:
    """List reference of every paragraph, id and level inherited separately.

    ``paragraphs`` has ``num_id`` and ``ilvl_raw`` (direct values as text).
    List id 0 stays 0; an id that is not a number gives none; a level outside
    0-8 becomes 0. ``inherited`` tells whether a style added something.
    """
    usual = defaults.filter(F.col("style_type") == "paragraph").select(
        "pkg_id", F.col("style_id").alias("usual")
    )
    style = resolved.select(
        "pkg_id",
        F.col("style_id").alias("effective"),
        "list_num_id",
        "list_ilvl",
        "list_from_style",
        "outline",
    )
    joined = (
        paragraphs.join(usual, "pkg_id", "left")
        .withColumn("effective", F.coalesce("style_id", "usual"))
        .join(style, ["pkg_id", "effective"], "left")
    )
    num = F.coalesce("num_id", "list_num_id")
    valid = num.rlike("^[0-9]+$")
    level = lenient_int(F.coalesce("ilvl_raw", "list_ilvl"))
    level = F.when(num == "0", level).otherwise(
        F.when(level.between(0, 8), level).otherwise(F.lit(0))
    )
    partial = F.col("num_id").isNull() | F.col("ilvl_raw").isNull()
    inherited = F.coalesce("list_from_style", F.lit(False)) & partial & valid
    return (
        joined.withColumn("eff_num_id", F.when(valid, num))
        .withColumn("eff_ilvl", F.when(valid, level.cast("int")))
        .withColumn("inherited", F.coalesce(inherited, F.lit(False)))
        .drop("usual", "list_num_id", "list_ilvl", "list_from_style")
    )


def materialize(referenced: DataFrame) -> DataFrame:
    """Body paragraphs whose list reference has to become their own.

    ``referenced`` comes from :func:`effective_reference` with ``level`` (the
    heading level). Headings are left to the source.
    """
    body = referenced.filter("level IS NULL AND eff_num_id IS NOT NULL")
    differs = ~(
        F.col("eff_num_id").eqNullSafe(F.col("num_id"))
        & F.col("eff_ilvl").eqNullSafe(lenient_int(F.col("ilvl_raw")).cast("int"))
    )
    return body.filter(differs).withColumn("counted", F.col("inherited") & (F.col("eff_num_id") != "0"))


def materialized(referenced: DataFrame) -> DataFrame:
    """All paragraphs, those of :func:`materialize` with the list reference as their own property.

    ``num_id``, ``ppr`` and ``has_ppr`` are the new ones; ``list_given`` marks the references that a style had added to.
    """
    body = F.col("level").isNull() & F.col("eff_num_id").isNotNull()
    differs = ~(
        F.col("eff_num_id").eqNullSafe(F.col("num_id"))
        & F.col("eff_ilvl").eqNullSafe(lenient_int(F.col("ilvl_raw")).cast("int"))
    )
    changes = body & differs
    attrs = F.map_filter(
        F.create_map(F.lit("ilvl"), F.col("eff_ilvl").cast("string"), F.lit("numId"), F.col("eff_num_id")),
        lambda _, v: v.isNotNull(),
    )
    given = override(F.coalesce("ppr", F.create_map().cast(BAG)), F.create_map(F.lit("numPr"), attrs))
    return referenced.select(
        *[c for c in referenced.columns if c not in ("num_id", "ppr", "has_ppr")],
        F.when(body, F.col("eff_num_id")).otherwise(F.col("num_id")).alias("num_id"),
        F.when(changes, given).otherwise(F.col("ppr")).alias("ppr"),
        (F.col("has_ppr") | changes).alias("has_ppr"),
        (changes & F.col("inherited") & (F.col("eff_num_id") != "0")).alias("list_given"),
    )


def referenced_lists(paragraphs: DataFrame) -> DataFrame:
    """Distinct direct list ids of body paragraphs."""
    return (
        paragraphs.filter("level IS NULL AND num_id IS NOT NULL").select("pkg_id", "num_id").distinct()
    )


def unresolvable(referenced: DataFrame, lists: DataFrame) -> DataFrame:
    """References without a usable list: not a number, or not defined."""
    wanted = referenced.filter("num_id <> '0'")
    invalid = wanted.filter(~F.col("num_id").rlike("^[0-9]+$")).withColumn("rule", F.lit("invalid_id"))
    gone = (
        wanted.filter(F.col("num_id").rlike("^[0-9]+$"))
        .join(lists, ["pkg_id", "num_id"], "left_anti")
        .withColumn("rule", F.lit("undefined_list"))
    )
    return invalid.unionByName(gone)


def number_order(c: Column) -> list[Column]:
    """Sort key for list ids: by value, ids that are no number last."""
    return [c.try_cast("decimal(38,0)").asc_nulls_last(), c.asc()]


def fresh_lists(wanted: DataFrame, used: DataFrame, keys=("pkg_id",)) -> DataFrame:
    """New ids for imported lists and their abstract lists.

    ``wanted`` has the keys, ``num_id, abstract_id`` (the target's), ``used`` has
    some of the keys and ``max_num, abstract_ids`` of the source. An abstract list keeps its
    id where that is free, else takes the next above every id in use, in the
    order its lists come; a concrete list always takes the next. Id zero stays
    zero. The window holds the lists of one package, which its numbering part
    bounds.
    """
    keys = list(keys)
    zero = wanted.filter("num_id = '0'").select(
        *keys, "num_id", F.lit("0").alias("new_num_id"),
        F.lit(None).cast("string").alias("abstract_id"),
        F.lit(None).cast("string").alias("new_abstract_id"),
    )
    real = wanted.filter(F.col("num_id").rlike("^[0-9]+$") & (F.col("num_id") != "0")).filter(
        "abstract_id IS NOT NULL"
    )
    order = Window.partitionBy(*keys).orderBy(*number_order(F.col("num_id")))
    placed = real.join(used, [k for k in keys if k in used.columns], "left").withColumn("pos", F.row_number().over(order))
    big = lambda c: c.try_cast("decimal(38,0)")
    taken0 = F.coalesce("abstract_ids", F.array().cast("array<string>"))

    def take(acc: Column, item: Column) -> Column:
        old = item["abstract_id"]
        seen = F.map_contains_key(acc["given"], old)
        digits = old.rlike("^[0-9]+$")
        free = digits & ~F.array_contains(acc["taken"], old)
        top = F.array_max(F.transform(acc["taken"], big))
        fresh = (F.coalesce(top, F.lit(-1)) + 1).cast("string")
        new = F.when(free, old).otherwise(fresh)
        grown = F.struct(
            F.array_append(acc["taken"], new).alias("taken"),
            F.map_concat(acc["given"], F.create_map(old, new)).alias("given"),
        )
        return F.when(seen, acc).otherwise(grown)

    start = F.struct(
        F.col("taken").alias("taken"), F.create_map().cast("map<string,string>").alias("given")
    )
    abstract_map = (
        placed.groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "abstract_id"))).alias("items"),
            F.first(taken0).alias("taken"),
        )
        .select(*keys, F.aggregate("items", start, take, lambda a: a["given"]).alias("given"))
    )
    fresh = (F.coalesce("max_num", F.lit(0)) + F.col("pos")).cast("string")
    imported = placed.join(abstract_map, keys).select(
        *keys,
        "num_id",
        fresh.alias("new_num_id"),
        "abstract_id",
        F.element_at("given", F.col("abstract_id")).alias("new_abstract_id"),
    )
    return imported.unionByName(zero)


def remap_lists(paragraphs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Point body paragraphs at the imported lists; headings and references
    without an import lose theirs."""
    new = mapping.select("pkg_id", "num_id", "new_num_id")
    return (
        paragraphs.join(new, ["pkg_id", "num_id"], "left")
        .withColumn("new_num_id", F.when(F.col("level").isNull(), F.col("new_num_id")))
        .withColumn(
            "preserved", F.coalesce(F.col("new_num_id") != "0", F.lit(False))
        )
    )


def isolate(abstracts: DataFrame, levels: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imported abstract lists without links to styles.

    ``imported`` has ``pkg_id, abstract_id, new_abstract_id``, and ``pack_id`` where the new ids depend on it.
    """
    keys = [k for k in ("pkg_id", "pack_id") if k in imported.columns]
    ids = imported.filter("new_abstract_id IS NOT NULL").select(
        *keys, "abstract_id", "new_abstract_id"
    ).distinct()
    none = F.lit(None).cast("string")

    def bring(rows: DataFrame, link: str) -> DataFrame:
        return (
            rows.join(ids, ["pkg_id", "abstract_id"])
            .withColumn("abstract_id", F.col("new_abstract_id"))
            .withColumn(link, none)
            .drop("new_abstract_id")
        )

    return bring(abstracts, "num_style_link"), bring(levels, "pstyle")


def content_identity(rows: DataFrame, content: Column, occupied: DataFrame) -> DataFrame:
    """Stable 32-bit identity of every list from its content.

    The identity is the head of the content's SHA-256, moved on past zero,
    identities in use and equal hashes. ``rows`` has ``pkg_id, ord``;
    ``occupied`` has ``pkg_id, nsid``. One package's lists are bounded by its
    numbering part, so the probe is a fold over a short array.
    """
    size = 1 << 32
    head = F.conv(F.substring(F.sha2(content, 256), 1, 8), 16, 10).cast("bigint")
    taken0 = occupied.groupBy("pkg_id").agg(
        F.collect_set(F.conv("nsid", 16, 10).cast("bigint")).alias("taken")
    )

    def place(acc: Column, item: Column) -> Column:
        busy = F.array_append(acc["taken"], F.lit(0).cast("bigint"))
        tries = F.transform(
            F.sequence(F.lit(0), F.size(busy)), lambda i: (item["head"] + i) % F.lit(size)
        )
        probed = F.filter(tries, lambda c: ~F.array_contains(busy, c))[0]
        free = F.when(F.array_contains(busy, item["head"]), probed).otherwise(item["head"])
        return F.struct(
            F.array_append(acc["taken"], free).alias("taken"),
            F.array_append(
                acc["out"], F.struct(item["ord"].alias("ord"), free.alias("identity"))
            ).alias("out"),
        )

    grouped = (
        rows.select("pkg_id", F.col("ord").cast("int").alias("ord"), head.alias("head"))
        .groupBy("pkg_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "head"))).alias("items"))
        .join(taken0, "pkg_id", "left")
    )
    start = F.struct(
        F.coalesce("taken", F.array().cast("array<bigint>")).alias("taken"),
        F.array().cast("array<struct<ord:int,identity:bigint>>").alias("out"),
    )
    placed = F.aggregate("items", start, place, lambda a: a["out"])
    return grouped.select("pkg_id", F.inline(placed)).withColumn(
        "identity", F.lpad(F.hex("identity"), 8, "0")
    )
