"""Operators on small tables and tiny packages."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from galley.operators import completion, graph, library, lists, ordering
from galley.sources import packages, sinks


def test_completion_of_missing_levels(spark):
    measured = spark.createDataFrame(
        [(1, "A", 42, 360, 200), (1, "B", 36, 280, 120), (1, "C", 30, 200, 80), (1, "N", 20, None, None)],
        "pkg_id int, style_id string, size int, before int, after int",
    )
    authority = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (1, 2, "C")], "pkg_id int, level int, style_id string")
    body = spark.createDataFrame([(1, "N")], "pkg_id int, style_id string")
    out = completion.complete_levels(authority, measured, body).orderBy("level").collect()
    assert [(r.level, r.size, r.before, r.after) for r in out] == [(3, 24, 120, 40), (4, 20, 40, 0)]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 3), f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(90)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, a, b in edges:
        ra, rb = root((p, a)), root((p, b))
        parent[max(ra, rb)] = min(ra, rb)
    got = graph.components(spark.createDataFrame(edges, "pkg_id int, a string, b string")).collect()
    assert {(r.pkg_id, r.node): r.root for r in got} == {k: root(k)[1] for k in parent}


def test_import_is_the_same_as_one_by_one(spark):
    rng = random.Random(5)
    rows = [(i, f"p{rng.randint(0, 12)}", f"c{rng.randint(0, 12)}", "x") for i in range(80)]
    stored = [("p1", "c3", "x"), ("p2", "c4", "x")]
    shelf, want = list((p, c) for p, c, _ in stored), []
    for _, pack, content, _ in rows:
        if any(p == pack and c != content for p, c in shelf):
            want.append("conflict")
        elif any(c == content for _, c in shelf):
            want.append("reuse")
        else:
            shelf.append((pack, content))
            want.append("append")
    incoming = spark.createDataFrame(rows, "seq int, pack_id string, fingerprint string, identity string")
    kept = spark.createDataFrame(stored, "pack_id string, fingerprint string, identity string")
    got = library.import_packs(incoming, kept).orderBy("seq").collect()
    assert [r.action for r in got] == want


def test_import_of_a_long_chain(spark):
    rows = []
    for i in range(300):
        rows += [(2 * i, f"p{i}", f"c{i}", "x"), (2 * i + 1, f"p{i}", f"c{i + 1}", "x")]
    rng = random.Random(1)
    order = sorted(range(len(rows)), key=lambda i: i + rng.random() * 3)
    rows = [(n, *rows[i][1:]) for n, i in enumerate(order)]
    ids, contents, want = {}, {}, []
    for _, pack, content, _ in rows:
        if ids.get(pack, content) != content:
            want.append("conflict")
        elif content in contents:
            want.append("reuse")
        else:
            ids[pack] = content
            contents[content] = pack
            want.append("append")
    incoming = spark.createDataFrame(rows, "seq int, pack_id string, fingerprint string, identity string")
    none = spark.createDataFrame([], "pack_id string, fingerprint string, identity string")
    got = library.import_packs(incoming, none).orderBy("seq").collect()
    assert [r.action for r in got] == want


def test_packs_that_differ_in_one_applied_field_are_two_packs(spark):
    from galley.registries import IDENTITY_FIELDS
    from galley.schemas import MANIFEST

    same = '"heading_authorities":{"1":"B","0":"A"},"used_table_styles":["T"],"preferred_table_style":"T","section_layouts":[["eA=="],[]]'
    rows = [
        ("a", "{%s}" % same), ("b", '{"section_layouts":[["eA=="],[]],"preferred_table_style":"T","used_table_styles":["T"],"heading_authorities":{"0":"A","1":"B"}}'),
        ("c", "{%s}" % same.replace('["eA=="],[]', '[],["eA=="]')), ("d", "{%s}" % same.replace('"preferred_table_style":"T"', '"preferred_table_style":"U"')),
        ("e", '{%s,"heading_numbering_user_edits":{"A":{"numbering_start":"2"}}}' % same), ("f", '{%s,"heading_paragraph_indents":{"A":{"left":"2"}}}' % same), ("g", '{%s,"name":"other"}' % same),
    ]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, pack_id string, json string")
    parsed = table.select("seq", "pack_id", F.from_json("json", MANIFEST).alias("manifest"), F.lit("same parts").alias("fingerprint"))
    incoming = library.application_identity(parsed).select("seq", "pack_id", "fingerprint", "identity")
    none = spark.createDataFrame([], "pack_id string, fingerprint string, identity string")
    got = {r.pack_id: (r.action, r.library_id) for r in library.import_packs(incoming, none).collect()}
    assert got == {"a": ("append", "a"), "b": ("reuse", "a"), "c": ("append", "c"), "d": ("append", "d"), "e": ("append", "e"), "f": ("append", "f"), "g": ("reuse", "a")}
    assert len(IDENTITY_FIELDS) == 8


def one_by_one(rows):
    ids, contents, out = {}, set(), []
    for _, pack, content, _ in rows:
        if ids.get(pack, content) != content:
            out.append("conflict")
        elif content in contents:
            out.append("reuse")
        else:
            ids[pack] = content
            contents.add(content)
            out.append("append")
    return out


def test_chains_are_decided_in_few_rounds(spark, monkeypatch):
    none = spark.createDataFrame([], "pack_id string, fingerprint string, identity string")
    steps = []
    kept = library.settled
    monkeypatch.setattr(library, "settled", lambda df: steps.append(1) or kept(df))
    for n in (64, 1000):
        rows = [(i, f"p{(i + 1) // 2}", f"c{i // 2}", "x") for i in range(n)]
        steps.clear()
        got = library.import_packs(spark.createDataFrame(rows, "seq int, pack_id string, fingerprint string, identity string"), none, most=10).orderBy("seq").collect()
        assert [r.action for r in got] == one_by_one(rows)
        assert len(steps) <= 20 + n.bit_length()


def test_tangles_longer_than_a_task_may_walk(spark):
    rng = random.Random(8)
    none = spark.createDataFrame([], "pack_id string, fingerprint string, identity string")
    rows = [(i, f"p{rng.randint(0, 60)}", f"c{rng.randint(0, 60)}", "x") for i in range(150)]
    rows += [(150 + i, f"q{(i + rng.randint(0, 2)) // 2}", f"d{i // 2}", "x") for i in range(100)]
    got = library.import_packs(spark.createDataFrame(rows, "seq int, pack_id string, fingerprint string, identity string"), none, most=1).orderBy("seq").collect()
    assert [r.action for r in got] == one_by_one(rows)


def test_scan_rejects_without_failing(spark, tmp_path):
    def archive(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "<x/>")
        return out.getvalue()

    good = archive(["[Content_Types].xml", "word/document.xml", "word/styles.xml"])
    late = bytearray(archive(["a.xml", "b.xml"]))
    late[late.rindex(b"b.xml", 0, late.index(b"PK\x01\x02")) + 5] ^= 255  # the second member's data
    cut = io.BytesIO()
    with zipfile.ZipFile(cut, "w") as z:
        z.writestr("word/document.xml", "<w:p")
    files = [("good", good), ("text", b"not a zip"), ("thin", archive(["word/document.xml"])), ("empty", archive([])), ("late", bytes(late)), ("cut", cut.getvalue()), ("bomb", None)]
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"0" * (4 << 20))
    files[-1] = ("bomb", bomb.getvalue())
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files], "path string, length bigint, content binary")
    scanned = packages.store_scan(df, str(tmp_path))
    assert {r.pkg_id for r in packages.members(scanned).collect()} == {"good", "thin"}
    faults = {(r.pkg_id, r.rule) for r in packages.rejects(scanned).collect()}
    assert faults >= {("text", "not_a_zip"), ("bomb", "over_limits"), ("thin", "missing_part"), ("empty", "empty_archive"), ("late", "corrupt"), ("cut", "malformed_xml")}
    assert {p for p, _ in faults} | {r.pkg_id for r in packages.accepted(scanned).collect()} == {p for p, _ in files}
    assert {r.pkg_id for r in packages.inventory(df).collect()} == {"good", "thin", "late", "cut", "bomb"}


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    packs = spark.createDataFrame([(f"p{i}", "f") for i in range(20)], "pack_id string, fingerprint string")
    parts = packs.selectExpr("pack_id", "'n' AS name")
    for run in ("a", "a", "b"):
        sinks.write_packs(packs, parts, str(tmp_path), run)
        sinks.write_plan({"x": packs}, str(tmp_path), run)
    for table in ("packs", "pack_parts", "plan_x"):
        assert spark.read.parquet(f"{tmp_path}/{table}").groupBy("run").count().orderBy("run").collect() == [("a", 20), ("b", 20)]


def test_places_and_caps(spark):
    rng = random.Random(2)
    ids = [(str(rng.randint(-5, 5000)),) for _ in range(300)] + [("x",), ("a1",), ("07",)]
    order = lists.number_order(F.col("id"))
    got = ordering.places(spark.createDataFrame(ids, "id string").distinct().repartition(5), *order).collect()
    want = sorted(set(i for i, in ids), key=lambda i: (not i.lstrip("-").isdigit(), int(i) if i.lstrip("-").isdigit() else 0, i))
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, len(want) + 1))
    many = spark.createDataFrame([("k", i % 400) for i in range(1000)] + [("m", 3)], "k string, v int")
    assert {r.k: r.v for r in ordering.capped(many, "k", "v", 64).collect()} == {"k": list(range(64)), "m": [3]}
