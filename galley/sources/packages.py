"""Package scan: files to members.

One pass reads each file once. The ZIP directory is checked against the size
limits before anything is decompressed, and a bad file becomes a reject row
instead of failing the job.
"""

from __future__ import annotations

import io
import os
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from galley import registries as R
from galley.operators.graph import settled
from galley.schemas import MEMBERS

_BATCH_BYTES = 16 * R.MIB
_BATCH_ROWS = 4096
_SUFFIXES = {"source": R.SOURCE_SUFFIXES, "target": R.TARGET_SUFFIXES, "pack": (R.PACK_SUFFIX,)}
_FILE_CAP = {
    "source": R.MAX_PACKAGE_FILE_BYTES,
    "target": R.MAX_PACKAGE_FILE_BYTES,
    "pack": R.MAX_PACK_FILE_BYTES,
}


def read_files(spark: SparkSession, folder: str, role: str = "source") -> DataFrame:
    """Files of a folder with the suffixes a role accepts."""
    glob = "*.{%s}" % ",".join(_SUFFIXES[role])
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def _too_large(infos: list[zipfile.ZipInfo]) -> bool:
    """Guard that keeps hostile archives from being decompressed at all."""
    if len(infos) > R.MAX_MEMBERS or sum(i.file_size for i in infos) > R.MAX_TOTAL_BYTES:
        return True
    for info in infos:
        xml = info.filename.lower().endswith((".xml", ".rels"))
        cap = R.MAX_XML_BYTES if xml else R.MAX_MEMBER_BYTES
        squeezed = info.file_size >= R.RATIO_FLOOR_BYTES and (
            info.file_size > R.MAX_RATIO * info.compress_size
        )
        odd = info.flag_bits & 1 or info.compress_type not in (R.STORED, R.DEFLATED)
        if info.file_size > cap or squeezed or odd:
            return True
    return False


def _opened(pkg_id: str, data: bytes) -> tuple[list[zipfile.ZipInfo], zipfile.ZipFile | None, str | None]:
    """ZIP directory of a file, its archive, and the fault that keeps it closed."""
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return [], None, "not_a_zip"
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, NotImplementedError, ValueError):
        return [], None, "corrupt"
    infos = archive.infolist()
    if all(i.is_dir() for i in infos):
        return infos, None, "empty_archive"
    return infos, archive, "over_limits" if _too_large(infos) else None


def _entry(pkg_id: str, ord_: int, info: zipfile.ZipInfo) -> dict:
    return {
        "pkg_id": pkg_id,
        "name": info.filename,
        "ord": ord_,
        "file_size": info.file_size,
        "compress_size": info.compress_size,
        "compress_type": info.compress_type,
        "flag_bits": info.flag_bits,
        "is_dir": info.is_dir(),
    }


def _readable_xml(data: bytes) -> bool:
    try:
        expat.ParserCreate().Parse(data, True)
    except expat.ExpatError:
        return False
    return True


def _members(pkg_id: str, data: bytes) -> Iterator[dict]:
    """Members one by one; a fault may come after members of the same file, so
    readers leave out every file that has one."""
    infos, archive, fault = _opened(pkg_id, data)
    if fault:
        yield {"pkg_id": pkg_id, "fault": fault}
        return
    for ord_, info in enumerate(infos):
        content = None
        if not info.is_dir():
            try:
                content = archive.read(info)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                yield {"pkg_id": pkg_id, "fault": "corrupt", "name": info.filename}
                return
            if info.filename.lower().endswith((".xml", ".rels")) and not _readable_xml(content):
                yield {"pkg_id": pkg_id, "fault": "malformed_xml", "name": info.filename}
        yield _entry(pkg_id, ord_, info) | {"content": content}


def _directory(pkg_id: str, data: bytes) -> Iterator[dict]:
    infos, _, fault = _opened(pkg_id, data)
    if fault and fault != "over_limits":
        yield {"pkg_id": pkg_id, "fault": fault}
    for ord_, info in enumerate(infos):
        yield _entry(pkg_id, ord_, info)


def _unpacked(files: DataFrame, role: str, rows: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(MEMBERS))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0
        for batch in batches:
            for pkg_id, data in zip(batch["path"].to_pylist(), batch["content"]):
                for row in rows(pkg_id, data.as_py()):
                    pending.append(row)
                    held += len(row.get("content") or b"")
                    if held > _BATCH_BYTES or len(pending) >= _BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(pending, schema=schema)
                        pending, held = [], 0
        yield pa.RecordBatch.from_pylist(pending, schema=schema)

    cap = _FILE_CAP[role]
    opened = files.filter(F.col("length") <= cap).select("path", "content")
    skipped = files.filter(F.col("length") > cap).select(
        F.col("path").alias("pkg_id"), F.lit("file_too_large").alias("fault")
    )
    return opened.mapInArrow(unpack, MEMBERS).unionByName(skipped, allowMissingColumns=True)


def scan(files: DataFrame, role: str = "source") -> DataFrame:
    """Member rows of every file, plus one row per file fault.

    ``files`` has ``path``, ``length`` and ``content`` as the binaryFile source
    gives them. Files over the byte cap are never opened.
    """
    return _unpacked(files, role, _members)


def inventory(files: DataFrame, role: str = "source") -> DataFrame:
    """ZIP directories as rows; nothing is decompressed."""
    return _unpacked(files, role, _directory).filter(F.col("fault").isNull()).drop("content", "fault")


# --- reading ranges of files ----------------------------------------------------------
#
# The sources above take a file's bytes as one value. These open files where they lie: the directory at a file's end tells
# what is inside, and members are then read by themselves, so no task holds more than one member.

#: Compressed bytes that one task inflates of one file, unless a single member is larger.
_SLOT_BYTES = 32 * R.MIB
_LISTING = "path string, length bigint, is_dir boolean"
DIRECTORY = "pkg_id string, name string, ord int, file_size bigint, compress_size bigint, compress_type int, flag_bits int, is_dir boolean, crc bigint, at bigint, fault string, bytes_read bigint"


class _Counted(io.RawIOBase):
    """A file opened for reading ranges, with the number of bytes it was asked for."""

    def __init__(self, path: str):
        scheme, found, rest = path.partition(":")
        local = not found or (scheme == "file")
        source, name = (fs.LocalFileSystem(), (rest if found else path).removeprefix("//")) if local else fs.FileSystem.from_uri(path)
        self.file, self.count = source.open_input_file(name), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.file.tell(), self.file.size())[whence]
        if to < 0:
            raise OSError("seek before the start of the file")
        return self.file.seek(to)

    def tell(self) -> int:
        return self.file.tell()

    def read(self, size: int = -1) -> bytes:
        data = self.file.read(None if size is None or size < 0 else size)
        self.count += len(data)
        return data

    def close(self) -> None:
        self.file.close()
        super().close()


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """``path, length, is folder`` of what lies in a folder; a local folder is read as a stream."""
    scheme, found, rest = folder.partition(":")
    if not found or scheme == "file":
        name = rest if found else folder
        with os.scandir(name[2:] if name.startswith("//") else name) as entries:
            for entry in entries:
                try:
                    is_dir = entry.is_dir()
                    yield f"{folder.rstrip('/')}/{entry.name}", 0 if is_dir else entry.stat().st_size, is_dir
                except FileNotFoundError:
                    continue
        return
    source, name = fs.FileSystem.from_uri(folder)
    for info in source.get_file_info(fs.FileSelector(name)):
        if info.type != fs.FileType.NotFound:
            yield f"{folder.rstrip('/')}/{info.base_name}", info.size or 0, info.type == fs.FileType.Directory


def _hidden(name: str) -> bool:
    """Names that Spark's own readers of folders pass over."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def listed(spark: SparkSession, folder: str, role: str = "source") -> DataFrame:
    """``path, length`` of the files a role accepts, as :func:`read_files` finds them (none that is empty); no bytes are read.

    Executors list the folders, one depth after the other, so the driver holds no list of files, however many there are.
    """
    accepted = tuple(f".{suffix}" for suffix in _SUFFIXES[role])
    schema = to_arrow_schema(StructType.fromDDL(_LISTING))
    tasks = 4 * spark.sparkContext.defaultParallelism

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = []
        for batch in batches:
            for at in batch["path"].to_pylist():
                for path, length, is_dir in _entries(at):
                    path = path.encode("utf-8", "replace").decode()  # a name that is no text is read as Spark reads it, and found unreadable
                    name = path.rpartition("/")[2]
                    if not _hidden(name) and (is_dir or length > 0 and name.endswith(accepted)):
                        pending.append({"path": path, "length": length, "is_dir": is_dir})
                        if len(pending) >= _BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(pending, schema=schema)
                            pending = []
        yield pa.RecordBatch.from_pylist(pending, schema=schema)

    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    given = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(top)
    if not given:
        return read_files(spark, folder, role).select("path", "length")  # says what is missing
    named = [(x.getPath().toString(), x.getLen(), x.isDirectory()) for x in given]
    lone = [(path, length) for path, length, is_dir in named if not is_dir and length > 0 and path.endswith(accepted)]
    files = spark.createDataFrame(lone, "path string, length bigint") if lone else None
    front = spark.createDataFrame([(path,) for path, _, is_dir in named if is_dir], "path string")
    while True:
        found = settled(front.mapInArrow(read, _LISTING).repartition(tasks, "path"))
        here = found.filter("NOT is_dir").select("path", "length")
        files = here if files is None else files.unionByName(here)
        front = found.filter("is_dir").select("path")
        if front.isEmpty():
            return files


def directories(files: DataFrame, role: str = "source") -> DataFrame:
    """ZIP directories of files by reading their ends: one row per member, and one per file with its fault, if any, and the
    number of bytes read. Files over the byte cap are not opened; one that cannot be opened is ``unreadable``."""
    schema = to_arrow_schema(StructType.fromDDL(DIRECTORY))
    cap = _FILE_CAP[role]

    def rows(path: str, length: int) -> Iterator[dict]:
        if length > cap:
            yield {"pkg_id": path, "fault": "file_too_large", "bytes_read": 0}
            return
        try:
            file = _Counted(path)
        except OSError:
            yield {"pkg_id": path, "fault": "unreadable", "bytes_read": 0}
            return
        with file:
            infos, fault = [], None
            try:
                if not zipfile.is_zipfile(file):
                    fault = "not_a_zip"
                else:
                    infos = zipfile.ZipFile(file).infolist()
                    if all(i.is_dir() for i in infos):
                        fault = "empty_archive"
                    elif _too_large(infos):
                        fault = "over_limits"
            except (zipfile.BadZipFile, NotImplementedError, ValueError):
                fault = "corrupt"
            yield {"pkg_id": path, "fault": fault, "bytes_read": file.count}
        for ord_, info in enumerate(infos):
            yield _entry(path, ord_, info) | {"crc": info.CRC, "at": info.header_offset}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = []
        for batch in batches:
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist()):
                for row in rows(path, length):
                    pending.append(row)
                    if len(pending) >= _BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(pending, schema=schema)
                        pending = []
        yield pa.RecordBatch.from_pylist(pending, schema=schema)

    # The ends of files ask for a few tasks a core, however many files and listings there are.
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "length").coalesce(tasks).mapInArrow(read, DIRECTORY)


def _inflated(file: _Counted, row: dict) -> bytes:
    """One member's bytes, read by its own range; never more than the directory declares."""
    file.seek(row["at"])
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no local header")
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(name + extra, 1)
    data = file.read(row["compress_size"])
    if row["compress_type"] == R.DEFLATED:
        reader = zlib.decompressobj(-15)
        data = reader.decompress(data, row["file_size"] + 1)
        if not reader.eof and len(data) == row["file_size"]:
            data += reader.decompress(reader.unconsumed_tail, 1)
    if len(data) != row["file_size"] or zlib.crc32(data) != row["crc"]:
        raise zipfile.BadZipFile("other bytes than declared")
    return data


def inflate(directory: DataFrame) -> DataFrame:
    """Members with their contents, as :func:`scan` gives them, of the files whose directories passed.

    Members of one file go to as many tasks as their bytes ask for, each of which opens the file once.
    """
    schema = to_arrow_schema(StructType.fromDDL(MEMBERS))
    faults = directory.filter("fault IS NOT NULL").select("pkg_id", "fault")
    wanted = directory.filter("name IS NOT NULL").join(faults.select("pkg_id").distinct(), "pkg_id", "left_anti")
    # At most 10,000 members per file have passed the limits.
    before = Window.partitionBy("pkg_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = wanted.withColumn("slot", F.floor(F.coalesce(F.sum("compress_size").over(before), F.lit(0)) / _SLOT_BYTES))

    def content(file: _Counted, row: dict) -> Iterator[dict]:
        kept = {k: row[k] for k in ("pkg_id", "name", "ord", "file_size", "compress_size", "compress_type", "flag_bits", "is_dir")}
        if row["is_dir"]:
            yield kept
            return
        try:
            data = _inflated(file, row)
        except (zipfile.BadZipFile, zlib.error, OSError, struct.error):
            yield {"pkg_id": row["pkg_id"], "fault": "corrupt", "name": row["name"]}
            return
        if row["name"].lower().endswith((".xml", ".rels")) and not _readable_xml(data):
            yield {"pkg_id": row["pkg_id"], "fault": "malformed_xml", "name": row["name"]}
        yield kept | {"content": data}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held, file, opened = [], 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if opened != row["pkg_id"]:
                    if file is not None:
                        file.close()
                    file, opened = _Counted(row["pkg_id"]), row["pkg_id"]
                for out in content(file, row):
                    pending.append(out)
                    held += len(out.get("content") or b"")
                if held > _BATCH_BYTES or len(pending) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(pending, schema=schema)
                    pending, held = [], 0
        if file is not None:
            file.close()
        yield pa.RecordBatch.from_pylist(pending, schema=schema)

    dealt = placed.repartition("pkg_id", "slot").sortWithinPartitions("pkg_id", "ord").drop("slot", "fault", "bytes_read")
    return dealt.mapInArrow(read, MEMBERS).unionByName(faults, allowMissingColumns=True)


def store_ranges(spark: SparkSession, folder: str, into: str, role: str = "source") -> DataFrame:
    """:func:`store_scan` of a folder by ranges: directories first, and only members of files within the limits are inflated."""
    directories(listed(spark, folder, role), role).write.mode("overwrite").parquet(f"{into}/directories")
    directory = spark.read.schema(DIRECTORY).parquet(f"{into}/directories")
    return _stored(inflate(directory), into)


def store_scan(files: DataFrame, folder: str, role: str = "source") -> DataFrame:
    """Scan files once into a table that every reader starts from.

    The table is partitioned by what a member is for, so a reader of styles opens
    the style parts alone. A repeated run replaces it.
    """
    return _stored(scan(files, role), folder)


def _stored(scanned: DataFrame, folder: str) -> DataFrame:
    kind = F.when(F.col("fault").isNotNull(), F.lit("fault"))
    for name, pattern in R.MEMBER_KINDS:
        kind = kind.when(F.col("name").rlike(pattern), F.lit(name))
    scanned = scanned.withColumn("kind", kind.otherwise(F.lit("other")))
    scanned.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/scan")
    return scanned.sparkSession.read.schema(f"{MEMBERS}, kind string").parquet(f"{folder}/scan")


def _is_member():
    """Rows with contents: neither faults nor folders. Told without reading the contents."""
    return F.col("fault").isNull() & ~F.col("is_dir")


def members(scanned: DataFrame) -> DataFrame:
    """Readable members of files without a fault."""
    faulty = scanned.filter(F.col("fault").isNotNull()).select("pkg_id").distinct()
    rows = scanned.filter(_is_member()).drop("fault")
    return rows.join(faulty, "pkg_id", "left_anti")


def missing_parts(parts: DataFrame, required=R.REQUIRED_PARTS) -> DataFrame:
    """Required parts a package lacks, one row each."""
    wanted = F.array(*[F.lit(p) for p in required])
    found = F.collect_set(F.when(F.col("name").isin(*required), F.col("name")))
    return (
        parts.groupBy("pkg_id")
        .agg(F.array_except(wanted, found).alias("missing"))
        .select("pkg_id", F.explode("missing").alias("part"))
    )


def rejects(scanned: DataFrame, required=R.REQUIRED_PARTS) -> DataFrame:
    """Why files were turned away: ``pkg_id, rule, detail``."""
    faults = scanned.filter(F.col("fault").isNotNull()).select(
        "pkg_id", F.col("fault").alias("rule"), F.col("name").alias("detail")
    )
    names = scanned.filter(_is_member()).select("pkg_id", "name")
    readable = names.join(faults.select("pkg_id").distinct(), "pkg_id", "left_anti")
    missing = missing_parts(readable, required).select(
        "pkg_id", F.lit("missing_part").alias("rule"), F.col("part").alias("detail")
    )
    return faults.unionByName(missing)


def accepted(scanned: DataFrame, required=R.REQUIRED_PARTS) -> DataFrame:
    """Files that are packages; with the rejects these are all files."""
    seen = scanned.select("pkg_id").distinct()
    return seen.join(rejects(scanned, required).select("pkg_id"), "pkg_id", "left_anti")


def tree_digest(manifest: DataFrame) -> DataFrame:
    """One digest over a whole tree, independent of how it was read: the hash of
    the sorted entries of each of 256 name ranges, hashed in order."""
    entry = F.concat_ws(" ", "sha256", "name")
    shard = F.substring(F.sha2(F.col("name"), 256), 1, 2)
    inside = manifest.filter(~F.col("outside")).select(shard.alias("shard"), F.sha2(entry, 256).alias("entry"))
    shards = inside.groupBy("shard").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), ""), 256).alias("digest"))
    listed = F.array_sort(F.collect_list(F.struct("shard", "digest")))
    return shards.agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["digest"]), ""), 256).alias("digest"))


def tree_manifest(files: DataFrame, root: str) -> DataFrame:
    """SHA-256 of every file below a root; files outside the root are marked."""
    inside = F.col("path").startswith(root)
    return files.select(
        F.when(inside, F.substring(F.col("path"), len(root) + 1, 1 << 20)).alias("name"),
        "path",
        F.sha2("content", 256).alias("sha256"),
        (~inside).alias("outside"),
    )
