"""Sharding by rendezvous hashing: every shard bids for every key, the best bid wins.

A key's shard depends on the key, the shard names and their weights alone. When a shard is added, its bid can only win over
the old winner, so rows move into the new shard and nowhere else; the share that moves is the new shard's share of the weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.common import pick, stored


def bid(key: Column, shard: int, weight: float) -> Column:
    """The cost of ``shard`` for ``key``: an exponential variable of rate ``weight``, fixed by the hash of both; least wins."""
    if weight <= 0:
        raise ValueError("a shard's weight must be positive")
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.struct((-F.log(unit) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def choose(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a key. Null keys are one key like any other."""
    bids = [bid(key, s, w) for s, w in enumerate(weights)]
    return (F.least(*bids) if len(bids) > 1 else bids[0]).getField("shard")


def rendezvous(df: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` with their shard, and a slot in it that counts from 0 without gaps.

    Returns ``key, size, text_crc32, shard, slot, grown_shard``: size is the text's UTF-8 bytes plus 1; ``grown_shard`` is the
    shard under the weights ``grown`` (null without them). Null text counts as empty, a null key is a key, repeated rows each
    get a slot, an empty table gives no rows, other columns are ignored.

    Slots: rows are numbered inside (shard, input partition), blocks that stay small however hot a key or shard is, and each
    block starts where the ones before it end. Only a few numbers per row are written and shuffled, never the text.
    """
    rows = pick(df, key, text)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = rows.select(
        F.col(key),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        choose(F.col(key), weights).cast("int").alias("shard"),
        (choose(F.col(key), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("block"),
    )
    # The block numbers must be the same for the count and for the rows, so they are written once.
    slim = stored(slim)
    counts = slim.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = Window.partitionBy("shard", "block").orderBy(key, "text_crc32", "size")
    return (
        slim.withColumn("row", F.row_number().over(place))
        .join(starts, ["shard", "block"])
        .select(key, "size", "text_crc32", "shard", (F.col("start") + F.col("row") - 1).cast("long").alias("slot"), "grown_shard")
    )
