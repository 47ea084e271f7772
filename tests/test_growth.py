"""Work that has to grow with the input: rows that steps make where many rows share one value."""

import os

import pytest
from pyspark.sql import functions as F

from galley.operators import fonts, graph
from galley.plans import apply as apply_plan


def most_rows(df) -> int:
    """The most rows that any join of the frame's plan made; runs the frame."""
    df.collect()
    found, seen = 0, [df._jdf.queryExecution().executedPlan()]
    while seen:
        node = seen.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            seen.append(node.plan())
        rows = node.metrics().get("numOutputRows")
        if "Join" in kind and rows.isDefined():
            found = max(found, rows.get().value())
        children = node.children()
        seen.extend(children.apply(i) for i in range(children.length()))
    return found


def test_font_searches_for_one_common_text(spark):
    names = [(f"Brand{i % 3}", f"Type {i % 7}", f"Brand{i % 3}-{i}", 5, False) for i in range(400)]
    asked = [(i, "brand") for i in range(200)] + [(200, "-39"), (201, "D1 1"), (202, "!"), (203, "e6"), (204, "brand2399x")]
    faces = spark.createDataFrame(names, "family string, localized string, postscript string, weight int, styled boolean")
    queries = spark.createDataFrame(asked, "query_id int, query string")
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    want = {(q, n[0].lower()) for q, text in asked if plain(text) for n in names if any(plain(text) in plain(x) for x in n[:3])}
    found = fonts.search_postings(fonts.name_postings(faces), queries)
    assert {(r.query_id, r.family_key) for r in found.collect()} == want
    assert most_rows(found) < 20 * len(names)


def test_finished_graphs_leave_the_rounds_of_components(spark, monkeypatch):
    """Five hundred pairs and one path of 200 nodes: only the path goes through further rounds."""
    pairs = [(k, "a", "b") for k in range(1, 501)]
    path = [(0, f"n{i * 37 % 200:03}", f"n{(i + 1) * 37 % 200:03}") for i in range(199)]
    loops = [(7, "z", "z"), (8, None, "y"), (None, "x", "w")]
    sizes, settle = [], graph.settled

    def counted(df):
        out = settle(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "settled", counted)
    edges = spark.createDataFrame(pairs + path + loops, "pkg_id int, a string, b string")
    got = [(r.pkg_id, r.node, r.root) for r in graph.components(edges).collect()]
    want = {(k, x, "a") for k in range(1, 501) for x in "ab"} | {(0, f"n{i:03}", "n000") for i in range(200)}
    want |= {(7, "z", "z"), (8, None, None), (8, "y", "y"), (None, "x", "x"), (None, "w", "w")}
    assert len(got) == len(want) and set(got) == want
    assert sum(size >= 500 for size in sizes) == 2
    whole = [(r.node, r.root) for r in graph.components(edges.select("a", "b").filter("a LIKE 'n%'"), ()).collect()]
    assert set(whole) == {(f"n{i:03}", "n000") for i in range(200)} and len(whole) == 200


def test_runs_that_count_alike_are_one_row(spark):
    """Sums of a package meet its packs, not its runs."""
    rows = [(p, "A" if i % 3 else None, {"b": {"val": "1"}} if i % 2 else {}) for p in (1, 2) for i in range(300)]
    runs = spark.createDataFrame(rows, "pkg_id int, style_id string, bag map<string,map<string,string>>").withColumn("kind", F.lit("run"))
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "pkg_id int, pack_id string")
    styles = spark.createDataFrame([(1, "x", "A", "A"), (1, "y", "A", "B"), (2, "x", "A", None)], "pkg_id int, pack_id string, style_id string, mapped string")
    alike = apply_plan.alike(runs)
    assert alike.count() == 8
    sums = lambda df: sorted(map(tuple, apply_plan._counted(apply_plan.plan_runs(df.join(pairs, "pkg_id"), styles), apply_plan._counts("runs")).collect()))
    assert sums(alike) == sums(runs) == [(1, "x", 300, 150, None), (1, "y", 300, 150, 200), (2, "x", 300, 150, 200)]


def test_style_sheets_are_resolved_once_for_transfer_statistics(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no driver tables")
    from harness import adapters
    from harness.queries import jobs

    read, calls = adapters.styles, []
    monkeypatch.setattr(adapters, "styles", lambda *given: calls.append(1) or read(*given))
    jobs.statistics(spark, folder)
    assert len(calls) == 1


def test_files_are_packed_in_bounded_batches():
    import pyarrow as pa

    from harness import documents

    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
    given = pa.RecordBatch.from_pylist([{"pkg_id": i, "parts": [{"name": "a", "content": b"x" * 1000}]} for i in range(1500)])
    packed = lambda i, parts: {"path": str(i), "length": 1000, "content": parts[0]["content"]}
    out = list(documents.packed_batches(iter([given, given]), packed, schema))
    assert [p for b in out for p in b["path"].to_pylist()] == [str(i) for i in range(1500)] * 2
    assert max(b.num_rows for b in out) <= 256
    large = lambda i, parts: {"path": str(i), "length": 1 << 20, "content": b""}
    assert max(b.num_rows for b in documents.packed_batches(iter([given]), large, schema)) <= 4


def test_parts_of_files_are_parsed_once(spark, tmp_path):
    """No table of a corpus, nor a profile's formats, still holds a parser of parts or the reading of archives."""
    from galley.plans import corpus, profile
    from galley.sources import packages
    from harness import documents

    scanned = packages.store_scan(documents.archives(spark, "/root/testdata/sf0.001"), str(tmp_path))
    tables = corpus.corpus_of(scanned, str(tmp_path / "corpus"))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in vars(tables).values()]
    plans.append(profile.profile(tables).formats._jdf.queryExecution().optimizedPlan().toString())
    assert not any("MapInArrow" in plan for plan in plans)
    good = packages.accepted(scanned).count()
    assert tables.styles.select("pkg_id").distinct().count() == good and tables.nodes.select("pkg_id").distinct().count() == good


def test_rejects_and_lists_of_a_transfer_cost_no_plan_of_paragraphs(spark, monkeypatch):
    from harness.queries import jobs

    def planned(*_):
        raise AssertionError("paragraphs were planned")

    monkeypatch.setattr(apply_plan, "plan_properties", planned)
    out = jobs.applied(spark, "/root/testdata/sf0.001")
    assert out.rejects.count() > 0 and out.levels.count() > 0


@pytest.mark.parametrize("name", ["w6_level_completion", "a5_rule_vote", "j21_pack_target_impact"])
def test_style_sheets_are_resolved_once(spark, name):
    """What is read several times is worked out before: the query's own plan holds no sheet any more."""
    import __spark_entry__ as entry

    out = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "sheet#" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_levels_and_rejects_of_a_derivation_need_no_style_sheet(spark, monkeypatch):
    from galley.operators import edits
    from harness.queries import jobs

    def replayed(*_):
        raise AssertionError("style sheets were replayed")

    monkeypatch.setattr(edits, "replay", replayed)
    first, second = jobs.derived(spark, "/root/testdata/sf0.001")
    assert first.rejects.count() > 0 and second.levels.count() > 0


def test_chains_of_arrivals_are_linked_by_number_and_walked_as_rows(spark, monkeypatch):
    """No text is a node of the rounds of components, and no chain is a group of its own."""
    from galley.operators import library

    given, find = [], library.components
    monkeypatch.setattr(library, "components", lambda edges, keys: given.append(edges) or find(edges, keys))
    rows = [(i, f"p{i // 2 if i % 40 else i}", f"c{(i + 1) // 2}") for i in range(200)] + [(300, "p301", "c300"), (301, "p301", "c301"), (302, "p302", "c301")]
    walked = library._walked(spark.createDataFrame(rows, "seq int, pack_id string, content_key string"), 50)
    assert dict(given[0].dtypes) == {"a": "int", "b": "int"}
    assert "FlatMapGroups" not in walked._jdf.queryExecution().executedPlan().toString()
    got = {r.seq: r.enters for r in walked.collect()}
    ids, contents, want = set(), set(), {}
    for seq, pack, content in rows:
        want[seq] = pack not in ids and content not in contents
        if want[seq]:
            ids.add(pack)
            contents.add(content)
    assert 0 < len(got) and all(want[s] == e for s, e in got.items())
    assert {300, 301, 302} <= set(got)


def test_directories_ask_for_tasks_by_cores_and_faults_are_told_without_contents(spark, tmp_path):
    from galley.sources import packages

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.docx").write_bytes(b"no zip")
    files = packages.listed(spark, str(tmp_path / "in"))
    many = files.unionByName(files)
    for _ in range(6):
        many = many.unionByName(many)
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert many.rdd.getNumPartitions() > tasks
    found = packages.directories(many)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() <= tasks and found.filter("fault = 'not_a_zip'").count() == 3 * 128
    scanned = packages.store_ranges(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    turned = packages.rejects(scanned)
    assert "content:binary" not in turned._jdf.queryExecution().executedPlan().toString() and turned.count() == 3


def exchanges(df) -> list[set[str]]:
    """Names of the columns that each shuffle of a frame's plan moves."""
    found, seen = [], [df._jdf.queryExecution().executedPlan()]
    while seen:
        node = seen.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
        if kind == "ShuffleExchangeExec":
            out = node.output()
            found.append({out.apply(i).name() for i in range(out.length())})
        children = node.children()
        seen.extend(children.apply(i) for i in range(children.length()))
    return found


def test_numbers_of_a_transfer_move_no_texts_or_properties(spark, monkeypatch):
    """Typed numbers and counts of properties are read before the joins, and paragraphs meet all answers in one of them."""
    from galley.operators import counters
    from harness.queries import jobs

    moved = []

    def seen(module):
        settle = module.settled
        monkeypatch.setattr(module, "settled", lambda df: moved.extend(exchanges(df)) or settle(df))

    seen(counters)
    seen(apply_plan)
    rows = jobs.applied(spark, "/root/testdata/sf0.001").paragraphs.filter("new_num_id IS NOT NULL")
    moved += exchanges(rows.select("pkg_id", "ord", "new_num_id", "value", "path", "matched"))
    nodes = [columns for columns in moved if "ord" in columns and "style_type" not in columns]
    assert nodes and not any(columns & {"text", "ppr"} for columns in nodes)


def test_style_sheets_are_moved_once(spark):
    from galley.operators import catalog

    rows = [(p, i, s, "paragraph", s, None, b, None, False, {}, {}) for p in (1, 2, None) for i, (s, b) in enumerate([("A", None), ("B", "A"), ("B", "C"), ("C", "B"), (None, None)])]
    columns = "pkg_id int, ord int, style_id string, style_type string, name string, aliases array<string>, based_on string, own_outline int, is_default boolean"
    styles = spark.createDataFrame(rows, columns + ", ppr map<string,map<string,string>>, rpr map<string,map<string,string>>")
    found = catalog.resolve(styles, False)
    assert len(exchanges(found)) == 1
    got = sorted((str(r.pkg_id), r.style_id, r.chain) for r in found.collect())
    assert got == sorted((p, s, c) for p in ("1", "2", "None") for s, c in [("A", ["A"]), ("B", ["B", "C"]), ("C", ["C", "B"])])


def test_font_aliases_move_links_once_and_large_keys_go_through_rounds(spark, monkeypatch):
    """The graph of one key is a row of its own, unless it has too many links; both ways give the same lists."""
    import random

    rng = random.Random(4)
    links = [(k, f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}") for k in (1, 2, None) for _ in range(18)]
    links += [(3, f"m{i}", f"m{i + 1}") for i in range(80)] + [(4, "x", None), (4, "x", "x"), (4, None, None), (5, "y", "z"), (5, "y", "z")]
    nodes = sorted({(k, n) for k, *ends in links for n in ends if n}, key=str)
    names = [(k, n, None if n == "n3" else n.upper(), None if n == "n4" else n[-1:]) for k, n in nodes] + [(1, "n5", "twice", "t"), (9, "n1", "N1", "n1")]
    edges = spark.createDataFrame(links, "pkg_id int, a string, b string").repartition("pkg_id")
    shown = spark.createDataFrame(names, "pkg_id int, node string, name string, fold string")
    rows = lambda df: sorted(((r.pkg_id, r.node, r.name, tuple(r.aliases)) for r in df.collect()), key=str)
    whole = graph.font_aliases(edges, shown)
    assert rows(whole) == rows(graph._aliases_by_rounds(edges, shown, ["pkg_id"])) and len(rows(whole)) > 80
    assert sum("a" in columns or "edges" in columns or "buf" in columns for columns in exchanges(whole)) <= 2
    assert max(len(r[3]) for r in rows(whole)) == 64
    monkeypatch.setattr(graph, "LINKS_PER_ROW", 50)
    assert rows(graph.font_aliases(edges, shown)) == rows(whole)
    assert dict(graph.font_aliases(edges, shown).dtypes) == dict(whole.dtypes)
