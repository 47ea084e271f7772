"""Pack libraries: hashes, identity, reconciliation and import."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from galley.operators.graph import components, settled
from galley.registries import IDENTITY_FIELDS


def part_hashes(parts: DataFrame) -> DataFrame:
    """SHA-256 of every part."""
    return parts.withColumn("sha256", F.sha2("content", 256))


def fingerprint(parts: DataFrame) -> DataFrame:
    """One hash over the sorted part names and hashes of a pack.

    A pack has at most 256 parts; the limits are checked before this runs.
    """
    line = F.concat(F.col("name"), F.lit("\0"), F.col("sha256"), F.lit("\n"))
    entries = F.array_sort(F.collect_list(F.struct("name", line.alias("line"))))
    joined = F.array_join(F.transform(entries, lambda e: e["line"]), "")
    return parts.groupBy("pack_id").agg(
        F.sha2(joined, 256).alias("fingerprint"), F.count(F.lit(1)).alias("part_count")
    )


def canonical_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _sorted_map(c: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def application_identity(manifests: DataFrame) -> DataFrame:
    """Canonical JSON of the manifest fields that decide what a pack applies.

    Maps are sorted by key, so equal content gives equal text.
    """
    by_key = lambda v: F.transform(
        F.array_sort(F.map_keys(v)),
        lambda k: F.struct(k.alias("key"), F.element_at(v, k).alias("value")),
    )
    columns = []
    for name in sorted(IDENTITY_FIELDS):
        value = F.col(f"manifest.{name}")
        if name == "heading_paragraph_properties":
            value = F.transform(
                by_key(value),
                lambda e: F.struct(
                    e["key"].alias("key"),
                    _sorted_map(e["value"]["ind"]).alias("ind"),
                    e["value"]["jc"].alias("jc"),
                    _sorted_map(e["value"]["spacing"]).alias("spacing"),
                ),
            )
        elif name in ("heading_paragraph_indents", "heading_numbering_user_edits"):
            value = F.transform(
                by_key(value),
                lambda e: F.struct(e["key"].alias("key"), _sorted_map(e["value"]).alias("value")),
            )
        elif name == "heading_numbering":
            value = by_key(value)
        elif name == "heading_authorities":
            value = _sorted_map(value)
        columns.append(value.alias(name))
    return manifests.withColumn("identity", canonical_json(F.struct(*columns)))


def reconcile(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared against computed part hashes, both ways; only differences."""
    d = declared.select("pack_id", "name", F.col("sha256").alias("declared"))
    a = actual.select("pack_id", "name", F.col("sha256").alias("computed"))
    return (
        d.join(a, ["pack_id", "name"], "full")
        .filter(~F.col("declared").eqNullSafe(F.col("computed")))
        .withColumn(
            "rule",
            F.when(F.col("declared").isNull(), F.lit("undeclared_part"))
            .when(F.col("computed").isNull(), F.lit("missing_part"))
            .otherwise(F.lit("hash_mismatch")),
        )
    )


def import_packs(incoming: DataFrame, stored: DataFrame, most: int = 100_000) -> DataFrame:
    """What happens to every incoming pack: ``reuse``, ``conflict`` or ``append``.

    Both sides have ``pack_id, fingerprint, identity``; incoming rows also have
    ``seq``, their arrival order. A pack that uses the id of different content
    is a conflict, against the library and against what earlier arrivals added.
    Equal content is stored once; copies are reduced to one row per id and
    content before anything else. Chains of more than ``most`` arrivals that hand
    ids and contents on are decided without any task holding one.
    """
    key = F.sha2(F.concat_ws("\0", "fingerprint", "identity"), 256)
    new = incoming.withColumn("content_key", key)
    old = stored.withColumn("content_key", key)
    by_content = old.groupBy("content_key").agg(F.min("pack_id").alias("stored_id"))
    by_id = old.groupBy("pack_id").agg(
        F.min("content_key").alias("low_key"), F.max("content_key").alias("high_key")
    )
    other = (F.col("low_key") != F.col("content_key")) | (F.col("high_key") != F.col("content_key"))
    checked = (
        new.join(by_content, "content_key", "left")
        .join(by_id, "pack_id", "left")
        .withColumn("clash", F.coalesce(other, F.lit(False)))
        .drop("low_key", "high_key")
    )
    free = checked.filter(~F.col("clash") & F.col("stored_id").isNull())
    added = _admit(free.groupBy("pack_id", "content_key").agg(F.min("seq").alias("seq")), most=most)
    id_owner = added.select(
        "pack_id", F.col("content_key").alias("owner_key"), F.col("seq").alias("owner_seq")
    )
    content_owner = added.select(
        "content_key", F.col("pack_id").alias("first_id"), F.col("seq").alias("first_seq")
    )
    decided = checked.join(id_owner, "pack_id", "left").join(content_owner, "content_key", "left")
    late = (F.col("owner_seq") < F.col("seq")) & (F.col("owner_key") != F.col("content_key"))
    action = (
        F.when(F.col("clash") | F.coalesce(late, F.lit(False)), F.lit("conflict"))
        .when(F.col("stored_id").isNotNull(), F.lit("reuse"))
        .when(F.col("seq") == F.col("first_seq"), F.lit("append"))
        .otherwise(F.lit("reuse"))
    )
    return decided.select(
        "seq",
        "pack_id",
        "fingerprint",
        "identity",
        action.alias("action"),
        F.when(action != "conflict", F.coalesce("stored_id", "first_id")).alias("library_id"),
    )


def _admit(arrivals: DataFrame, rounds: int = 4, most: int = 100_000) -> DataFrame:
    """Arrivals that enter the library: the first to bring both a free id and
    free content.

    An arrival that is the earliest for its id and for its content is certain and
    takes both. A few such rounds settle all but chains of ids and contents that
    hand each other on. Chains are independent of each other: each one of at most
    ``most`` arrivals is then walked in order by one task. Longer ones are decided by
    pointer jumping (see :func:`_chained`), which takes a number of steps that grows
    with the logarithm of their length. Every round decides the earliest arrival
    that is left, so there are never more rounds than arrivals.
    """
    left = settled(arrivals)
    admitted = left.limit(0)
    done = 0
    while not left.isEmpty():
        done += 1
        if done < rounds:
            sure = settled(_firsts(left).filter("seq = first_of_id AND seq = first_of_content").select("pack_id", "content_key", "seq"))
            open_ = left
        else:
            decided = _walked(left, most) if done == rounds else _chained(left)
            decided = settled(decided)
            sure = decided.filter("enters").select("pack_id", "content_key", "seq")
            open_ = left.join(decided.select("seq"), "seq", "left_anti")
        admitted = admitted.unionByName(sure)
        left = settled(
            open_.join(sure.select("pack_id"), "pack_id", "left_anti").join(
                sure.select("content_key"), "content_key", "left_anti"
            )
        )
    return admitted


def _firsts(left: DataFrame) -> DataFrame:
    """Arrivals with the earliest one of their id and of their content."""
    first_of = lambda col, name: left.groupBy(col).agg(F.min("seq").alias(name))
    return left.join(first_of("pack_id", "first_of_id"), "pack_id").join(first_of("content_key", "first_of_content"), "content_key")


def _chained(left: DataFrame) -> DataFrame:
    """Arrivals that are decided, with ``enters``: those with nothing before them, and all that hang on these by a chain.

    An arrival with exactly one undecided arrival before it, by id or by content, enters exactly if that one does not. So
    each such arrival points to the one before it, and every step lets it point twice as far, counting hops, until it meets a
    decided one. Arrivals with two or more before them wait for the next round, and so does what hangs on them.
    """
    firsts = settled(_firsts(left))
    second = lambda col, first, name: firsts.filter(F.col("seq") > F.col(first)).groupBy(col).agg(F.min("seq").alias(name))
    placed = firsts.join(second("pack_id", "first_of_id", "second_of_id"), "pack_id", "left").join(
        second("content_key", "first_of_content", "second_of_content"), "content_key", "left"
    )
    lone = lambda kind: F.col("seq") == F.col(f"first_of_{kind}")
    next_ = lambda kind: F.coalesce(F.col("seq") == F.col(f"second_of_{kind}"), F.lit(False))
    sure = lone("id") & lone("content")
    by_id, by_content = next_("id") & lone("content"), next_("content") & lone("id")
    # An arrival that is second for both hangs on one arrival only where that is the same one.
    by_both = next_("id") & next_("content") & (F.col("first_of_id") == F.col("first_of_content"))
    nodes = settled(
        placed.filter(sure | by_id | by_content | by_both).select(
            "pack_id", "content_key", "seq",
            F.when(by_id | by_both, F.col("first_of_id")).when(by_content, F.col("first_of_content")).alias("to"),
            F.lit(True).alias("odd"), F.when(sure, F.lit(True)).alias("enters"), F.lit(False).alias("stuck"),
        )
    )
    # Only links that are still open are joined, and those point to different arrivals, so that no key is hot.
    while not (open_ := nodes.filter("enters IS NULL AND NOT stuck")).isEmpty():
        ahead = nodes.select(
            F.col("seq").alias("to"), F.col("to").alias("far"), F.col("odd").alias("far_odd"), F.col("enters").alias("far_enters"), F.col("stuck").alias("far_stuck"), F.lit(True).alias("met")
        )
        met = F.col("met").isNotNull()
        moved = open_.join(ahead, "to", "left").select(
            "pack_id", "content_key", "seq",
            F.when(F.col("far_enters").isNull() & met, F.col("far")).otherwise(F.col("to")).alias("to"),
            F.when(F.col("far_enters").isNull() & met, F.col("odd") != F.col("far_odd")).otherwise(F.col("odd")).alias("odd"),
            (F.col("far_enters") != F.col("odd")).alias("enters"),
            (~met | F.coalesce("far_stuck", F.lit(False))).alias("stuck"),
        )
        nodes = settled(nodes.filter("enters IS NOT NULL OR stuck").unionByName(moved))
    return nodes.filter("enters IS NOT NULL").select("pack_id", "content_key", "seq", "enters")


def _walked(left: DataFrame, most: int) -> DataFrame:
    """Arrivals of chains of at most ``most``, with whether each enters.

    An arrival is linked to the first ones of its id and of its content, by their numbers. Chains are walked one after the
    other as they come, sorted, so that short ones cost no more than their rows.
    """
    firsts = _firsts(left)
    links = firsts.select(F.col("seq").alias("a"), F.explode(F.array("first_of_id", "first_of_content")).alias("b"))
    chain = components(links, ()).select(F.col("node").alias("seq"), F.col("root").alias("chain"))
    named = left.select("pack_id", "content_key", "seq").join(chain, "seq")
    short = named.groupBy("chain").count().filter(F.col("count") <= most).select("chain")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, contents = None, set(), set()
        for batch in batches:
            enters = []
            for chain, pack, content in zip(*(batch.column(c).to_pylist() for c in ("chain", "pack_id", "content_key"))):
                if chain != here:
                    here, ids, contents = chain, set(), set()
                enters.append(pack not in ids and content not in contents)
                if enters[-1]:
                    ids.add(pack)
                    contents.add(content)
            kept = batch.select(["pack_id", "content_key", "seq"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(enters, pa.bool_())], names=[*kept.schema.names, "enters"])

    types = dict(left.dtypes)
    ddl = ", ".join(f"{c} {types[c]}" for c in ("pack_id", "content_key", "seq"))
    dealt = named.join(short, "chain").repartition("chain").sortWithinPartitions("chain", "seq")
    return dealt.mapInArrow(walk, f"{ddl}, enters boolean")


def stale_pairs(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """Requested pairs whose report is missing or bound to other inputs."""
    bound = ["pack_id", "pkg_id", "pack_sha256", "target_sha256", "options"]
    return pairs.join(reports.select(*bound), bound, "left_anti")


def newest_first(packs: DataFrame) -> DataFrame:
    return packs.orderBy(F.col("created_at").desc_nulls_last())
