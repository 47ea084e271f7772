"""The edit log of packs: append-only revisions, snapshots, and reading what is still in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EDITS = "pack_id string, style_id string, field string, value string, seq int"


class EditLog:
    """Edits of all packs of a library, by revision.

    A revision is one folder that a repeat replaces, so a job that failed half-way is run again as it was. A snapshot holds, for
    every style and field, the last edit up to a revision; readers take the newest snapshot that is marked as complete and the
    revisions after it. A field's earlier values never matter: whatever an edit touches, the last edit of that field touches too.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        nothing = spark.createDataFrame([], EDITS)
        self._write(nothing, "revisions/revision=0", "ignore")
        self._write(nothing.withColumn("revision", F.lit(0)), "snapshots/snapshot=0", "ignore")
        self._mark(0, "ignore")

    def _write(self, df: DataFrame, name: str, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(f"{self.folder}/{name}")

    def _mark(self, revision: int, mode: str = "overwrite") -> None:
        self._write(self.spark.range(1).select(F.lit(True).alias("complete")), f"marks/snapshot={revision}", mode)

    def _newest(self) -> int:
        return self.spark.read.parquet(f"{self.folder}/marks").agg(F.max("snapshot")).first()[0]

    def append(self, revision: int, edits: DataFrame) -> None:
        """Adds the edits of a revision, in order of pack and style."""
        if revision <= 0:
            raise ValueError("revisions count from 1")
        rows = edits.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in EDITS.split(", ")])
        self._write(rows.repartitionByRange("pack_id", "style_id").sortWithinPartitions("pack_id", "style_id"), f"revisions/revision={revision}")

    def rows(self, upto: int | None = None) -> DataFrame:
        """Edits that are in force, with their ``revision``; only revisions after the newest snapshot are read.

        With ``upto``, later revisions do not count; it must not lie before the newest snapshot.
        """
        newest = self._newest()
        if upto is not None and upto < newest:
            raise ValueError(f"revisions up to {newest} are in a snapshot already")
        held = self.spark.read.schema(EDITS + ", revision int, snapshot int").parquet(f"{self.folder}/snapshots").filter(F.col("snapshot") == newest).drop("snapshot")
        later = self.spark.read.schema(EDITS + ", revision int").parquet(f"{self.folder}/revisions").filter(F.col("revision") > newest)
        if upto is not None:
            later = later.filter(F.col("revision") <= upto)
        return held.unionByName(later)

    def compact(self, revision: int) -> None:
        """A snapshot of everything up to ``revision``. It is read once its mark is written."""
        last = F.max_by(F.struct("value", "seq", "revision"), F.struct("revision", "seq"))
        live = self.rows(revision).groupBy("pack_id", "style_id", "field").agg(last.alias("e"))
        rows = live.select("pack_id", "style_id", "field", "e.value", "e.seq", "e.revision")
        self._write(rows.repartitionByRange("pack_id", "style_id").sortWithinPartitions("pack_id", "style_id"), f"snapshots/snapshot={revision}")
        self._mark(revision)
