"""Reading packages by ranges against reading them whole."""

import io
import os
import random
import zipfile

import pytest

from galley.sources import packages

XML = b"<a/>"


def archive(entries, level=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", level) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(1 << 18))
    good = [("[Content_Types].xml", XML), ("word/document.xml", XML * 1), ("word/styles.xml", XML), ("word/empty.xml", XML), ("media/a.bin", noise * 4), ("media/zeros.bin", b"\0" * 5000), ("dir/", b"")]
    files = {
        "good.docx": archive(good), "stored.docx": archive(good, zipfile.ZIP_STORED), "cut.docx": archive(good)[:-40], "text.docx": b"no archive", "nothing.docx": b"", "empty.docx": archive([]),
        "only dirs.docx": archive([("a/", b"")]), "bad xml.docx": archive([("word/document.xml", b"<a>")]), "bomb.docx": archive([("media/zeros.bin", b"\0" * (8 << 20))]), "other.txt": archive(good),
        "prefixed.docx": b"some bytes before" + archive(good),
    }
    data = bytearray(files["stored.docx"])
    at = data.index(noise[:64])
    data[at] ^= 1
    files["flipped.docx"] = bytes(data)
    os.makedirs(tmp_path / "files/deep")
    for i, (name, body) in enumerate(files.items()):
        (tmp_path / "files" / ("deep" if i % 2 else ".") / name).write_bytes(body)
    return str(tmp_path / "files")


def rows(df):
    return sorted(str((r.pkg_id, r.name, r.ord, r.file_size, r.compress_size, r.is_dir, bytes(r.content or b""))) for r in df.collect())


def test_ranges_give_what_whole_files_give(spark, folder, monkeypatch, tmp_path):
    whole = packages.scan(packages.read_files(spark, folder))
    for slot in (packages._SLOT_BYTES, 1000):
        monkeypatch.setattr(packages, "_SLOT_BYTES", slot)
        found = packages.store_ranges(spark, folder, str(tmp_path / f"out{slot}")).drop("kind")
        assert rows(packages.members(found)) == rows(packages.members(whole))
        assert sorted(map(tuple, packages.rejects(found).collect())) == sorted(map(tuple, packages.rejects(whole).collect()))
        assert packages.accepted(found).count() == packages.accepted(whole).count() == 3


def test_directories_read_the_ends_of_files_alone(spark, folder):
    files = packages.listed(spark, folder)
    found = {r.pkg_id.rpartition("/")[2]: r for r in packages.directories(files).filter("name IS NULL").collect()}
    sizes = {r.path.rpartition("/")[2]: r.length for r in files.collect()}
    assert set(found) == set(sizes) and "other.txt" not in found
    assert found["good.docx"].fault is None and found["good.docx"].bytes_read < sizes["good.docx"] / 500
    assert found["bomb.docx"].fault == "over_limits" and found["only dirs.docx"].fault == "empty_archive"
    # The limits turn a file away before anything of it is inflated.
    assert packages.inflate(packages.directories(files)).filter("pkg_id LIKE '%bomb.docx' AND content IS NOT NULL").count() == 0
    assert packages.directories(files.limit(0)).count() == 0


def test_missing_files_are_rejects(spark):
    gone = spark.createDataFrame([("file:/nowhere/a.docx", 10), ("file:/nowhere/b.docx", 1 << 60)], "path string, length bigint")
    assert sorted(r.fault for r in packages.directories(gone).collect()) == ["file_too_large", "unreadable"]


def test_folders_are_listed_by_executors_as_spark_lists_them(spark, tmp_path, monkeypatch):
    """The same files as Spark's own reader finds, without a list of them on the driver."""
    top = tmp_path / "in"
    for name in ("a.docx", "deep/er/b c.docx", "deep/d.DOCX", "deep/._COPYING_/h.docx", "_temp/e.docx", "_k=1/f.docx", ".git/g.docx", "deep/_h.docx", "deep/.i.docx", "x.docx/j.docx", "deep/k.txt", "dotm/l.dotx"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"x" * len(name))
    (top / "deep/nothing.docx").write_bytes(b"")
    os.makedirs(top / "empty")
    os.symlink(top / "a.docx", top / "deep/link.docx")
    os.symlink(top / "nowhere", top / "gone.docx")
    rows = lambda df: sorted(map(tuple, df.select("path", "length").collect()))
    asked = [str(top), f"file://{top}", f"{top}/*", str(top / "a.docx"), str(top / "empty")]
    wanted = {}
    os.remove(top / "gone.docx")
    for at in asked:
        wanted[at] = rows(packages.read_files(spark, at))
    os.symlink(top / "nowhere", top / "gone.docx")
    monkeypatch.setattr(packages, "read_files", None)
    for at in asked[:2] + asked[3:]:
        assert rows(packages.listed(spark, at)) == wanted[at]
    os.remove(top / "gone.docx")
    assert rows(packages.listed(spark, asked[2])) == wanted[asked[2]]
    assert len(wanted[str(top)]) > 4


def test_files_of_packages_are_dealt_to_subfolders(spark, tmp_path):
    from harness import documents

    at = documents.files(spark, "/root/testdata/sf0.001", str(tmp_path / "files"))
    sizes = [len(names) for _, _, names in os.walk(at)]
    assert sum(sizes) == 200 and max(sizes) < 20
    assert packages.listed(spark, at).count() == 200
