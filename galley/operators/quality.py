"""Validation rules. Every rule set yields ``rule, detail`` rows per entity and
never raises; an entity without rows passes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from galley import registries as R
from galley.functions.fonts import alias_key
from galley.functions.numerals import pattern_fault
from galley.functions.paths import is_xml_part, rel_role, resolve_target, unsafe_name
from galley.functions.text import casefold, has_control, human_size
from galley.functions.units import lenient_int, on_off, on_step


def rule(name: str, bad: Column, detail: Column | None = None) -> Column:
    shown = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return F.struct(
        F.coalesce(bad, F.lit(False)).alias("bad"), F.lit(name).alias("rule"), shown.alias("detail")
    )


def broken(rules: list[Column]) -> Column:
    """Rules of a row that fail, as rows of ``rule, detail``."""
    failed = F.filter(F.array(*rules), lambda r: r["bad"])
    return F.inline(
        F.transform(failed, lambda r: F.struct(r["rule"].alias("rule"), r["detail"].alias("detail")))
    )


def member_rules(inventory: DataFrame) -> DataFrame:
    """Limits and safety of single members, from ZIP metadata alone."""
    size, packed = F.col("file_size"), F.col("compress_size")
    folder = F.col("is_dir")
    file = ~folder
    big = file & (size >= R.RATIO_FLOOR_BYTES)
    fault = unsafe_name(F.col("name"))
    shown = F.concat(F.col("name"), F.lit(" "), human_size(size))
    return inventory.select(
        "pkg_id",
        broken(
            [
                rule("unsafe_name", fault.isNotNull(), fault),
                rule("encrypted", F.col("flag_bits").bitwiseAND(1) != 0, F.col("name")),
                rule("compression", ~F.col("compress_type").isin(R.STORED, R.DEFLATED), F.col("name")),
                rule("negative_size", (size < 0) | (packed < 0), F.col("name")),
                rule("full_folder", folder & ((size != 0) | (packed != 0)), F.col("name")),
                rule("member_size", file & (size > R.MAX_MEMBER_BYTES), shown),
                rule("xml_size", file & is_xml_part(F.col("name")) & (size > R.MAX_XML_BYTES), shown),
                rule("ratio", big & (size > packed * R.MAX_RATIO), shown),
            ]
        ),
    )


def package_totals(inventory: DataFrame) -> DataFrame:
    """Member count, total size and maxima of every package."""
    file = ~F.col("is_dir")
    return inventory.groupBy("pkg_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.coalesce(F.sum(F.when(file, F.col("file_size"))), F.lit(0)).alias("total_size"),
        F.coalesce(F.max(F.when(file, F.col("file_size"))), F.lit(0)).alias("max_size"),
        F.bool_or(file & (F.col("file_size") > R.MAX_MEMBER_BYTES)).alias("oversized"),
    )


def package_rules(
    inventory: DataFrame, max_members: int = R.MAX_MEMBERS, max_total: int = R.MAX_TOTAL_BYTES
) -> DataFrame:
    """All package limits: single members, totals and repeated names."""
    totals = package_totals(inventory).select(
        "pkg_id",
        broken(
            [
                rule("member_count", F.col("members") > max_members, F.col("members")),
                rule("total_size", F.col("total_size") > max_total, human_size(F.col("total_size"))),
            ]
        ),
    )
    repeated = (
        inventory.groupBy("pkg_id", "name")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("pkg_id", F.lit("repeated_name").alias("rule"), F.col("name").alias("detail"))
    )
    return member_rules(inventory).unionByName(totals).unionByName(repeated)


def pack_limits(
    inventory: DataFrame,
    max_members: int = R.MAX_PACK_MEMBERS,
    max_member: int = R.MAX_PACK_MEMBER_BYTES,
    max_total: int = R.MAX_PACK_TOTAL_BYTES,
) -> DataFrame:
    """Tighter limits of format packs."""
    known = (F.col("name") == "manifest.json") | F.col("name").startswith(R.PACK_PART_PREFIX)
    single = inventory.select(
        "pkg_id",
        broken(
            [
                rule("unknown_entry", ~known, F.col("name")),
                rule("entry_size", F.col("file_size") > max_member, F.col("name")),
            ]
        ),
    )
    totals = (
        inventory.groupBy("pkg_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("total"))
        .select(
            "pkg_id",
            broken(
                [
                    rule("entry_count", F.col("n") > max_members, F.col("n")),
                    rule("pack_size", F.col("total") > max_total, human_size(F.col("total"))),
                ]
            ),
        )
    )
    return single.unionByName(totals)


def relationship_rules(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Relationships of a pack: known format roles, internal, unique, to
    existing Word parts, and a main style part.

    ``rels`` has ``pkg_id, rel_id, rel_type, target, target_mode``; ``parts``
    ``pkg_id, part``.
    """
    types = list(R.ROLE_REL_TYPE.values())
    target, mode = F.col("target"), F.col("target_mode")
    part = resolve_target(F.lit("word/document.xml"), target)
    placed = rels.withColumn("part", part).withColumn("role", rel_role(F.col("rel_type")))
    wordy = F.col("part").startswith("word/") & F.col("part").endswith(".xml") & ~F.col("part").contains("/_rels/")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    present = parts.select("pkg_id", "part").distinct().withColumn("present", F.lit(True))
    single = placed.join(present, ["pkg_id", "part"], "left").select(
        "pkg_id",
        broken(
            [
                rule("rel_type", ~F.coalesce(F.col("rel_type"), F.lit("")).isin(*types), F.col("rel_type")),
                rule("rel_blank", blank(F.col("rel_id")) | blank(target), F.col("rel_id")),
                rule("rel_external", ~F.coalesce(mode, F.lit("Internal")).isin("Internal"), target),
                rule("rel_path", target.rlike(r"[\\#?:%]"), target),
                rule("rel_target", F.coalesce(~wordy, F.lit(True)), target),
                rule("rel_dangling", wordy & F.col("present").isNull(), F.col("part")),
            ]
        ),
    )

    def twice(key: str, name: str) -> DataFrame:
        return (
            placed.groupBy("pkg_id", key)
            .agg(F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
            .select("pkg_id", F.lit(name).alias("rule"), F.col(key).alias("detail"))
        )

    main = (F.col("role") == "styles") & (F.col("part") == "word/styles.xml")
    headless = (
        placed.groupBy("pkg_id")
        .agg(F.bool_or(F.coalesce(main, F.lit(False))).alias("ok"))
        .filter("NOT ok")
        .select("pkg_id", F.lit("no_style_part").alias("rule"), F.lit(None).cast("string").alias("detail"))
    )
    out = single
    for extra in (twice("role", "rel_role_twice"), twice("rel_id", "rel_id_twice"), twice("part", "rel_part_twice"), headless):
        out = out.unionByName(extra)
    return out


def tag_rules(tags: DataFrame) -> DataFrame:
    """Tags of format parts: the right root, nothing that carries content.

    ``tags`` has ``pkg_id, role, tag, is_root, is_top, rel_attrs``.
    """
    root = reduce(
        lambda acc, kv: F.when(F.col("role") == kv[0], F.lit(kv[1])).otherwise(acc),
        R.ROLE_ROOT_TAG.items(),
        F.lit("settings"),
    )
    top = (F.col("role") == "settings") & F.col("is_top")
    return tags.select(
        "pkg_id",
        broken(
            [
                rule("root_tag", F.col("is_root") & (F.col("tag") != root), F.col("tag")),
                rule("forbidden_tag", F.col("tag").isin(*R.FORBIDDEN_TAGS), F.col("tag")),
                rule("relationship_attribute", F.col("rel_attrs") > 0, F.col("tag")),
                rule("settings_tag", top & ~F.col("tag").isin(*R.SETTINGS_TAGS), F.col("tag")),
            ]
        ),
    )


def content_type_rules(types: DataFrame) -> DataFrame:
    """Content type declarations: known, right and declared once.

    ``types`` has ``pkg_id, kind, key, role, content_type``; ``role`` is that
    of the part an Override names.
    """
    extension = casefold(F.col("key"))
    default_ok = F.lit(False)
    for ext, allowed in R.DEFAULT_CONTENT_TYPES.items():
        default_ok = default_ok | ((extension == ext) & F.col("content_type").isin(*allowed))
    override_ok = F.lit(False)
    for role, wanted in R.PART_CONTENT_TYPE.items():
        override_ok = override_ok | ((F.col("role") == role) & (F.col("content_type") == wanted))
    ok = F.when(F.col("kind") == "Default", default_ok).when(F.col("kind") == "Override", override_ok)
    single = types.select("pkg_id", broken([rule("content_type", ~F.coalesce(ok, F.lit(False)), F.col("key"))]))
    twice = (
        types.groupBy("pkg_id", "kind", extension.alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("pkg_id", F.lit("content_type_twice").alias("rule"), F.col("k").alias("detail"))
    )
    return single.unionByName(twice)


def _text(c: Column, longest: int, empty_ok: bool = False) -> Column:
    """True for a bad manifest text."""
    bad = (F.length(c) > longest) | has_control(c)
    if not empty_ok:
        bad = bad | c.isNull() | (c == "")
    return F.coalesce(bad, F.lit(not empty_ok))


_OPTIONAL_TEXTS = (
    "inference_label", "font_latin", "font_east_asia", "color_hex", "alignment", "line_rule",
    "numbering_format", "numbering_pattern", "numbering_example", "table_fill_hex",
    "table_accent_hex", "table_border_style", "table_border_color_hex",
)


def _aliases_bad(aliases: Column) -> Column:
    return F.coalesce(
        (F.size(aliases) > R.MAX_FONT_ALIASES) | F.exists(aliases, lambda a: _text(a, 1024)),
        F.lit(False),
    )


def _format_rules(f: Column) -> list[Column]:
    levels = [f["outline_level"], f["numbering_level"]]
    numbers = [
        f[n]
        for n in (
            "size_pt", "space_before_pt", "space_after_pt", "line_spacing", "left_indent_pt",
            "right_indent_pt", "first_line_indent_pt", "hanging_indent_pt", "left_indent_chars",
            "right_indent_chars", "first_line_indent_chars", "hanging_indent_chars",
            "table_border_width_pt", "table_cell_margin_top_pt", "table_cell_margin_bottom_pt",
            "table_cell_margin_left_pt", "table_cell_margin_right_pt",
        )
    ]
    any_of = lambda tests: reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
    stories = F.map_entries(f["usage_by_story"])
    story_bad = F.exists(
        stories, lambda e: _text(e["key"], 128) | F.coalesce(e["value"] < 0, F.lit(True))
    )
    endless = lambda n: F.isnan(n) | (F.abs(n) == float("inf"))
    return [
        rule("format_id", _text(f["style_id"], 255), f["style_id"]),
        rule("format_type", ~F.coalesce(f["type"].isin("paragraph", "character", "table"), F.lit(False)), f["style_id"]),
        rule("format_name", _text(f["name"], 512), f["style_id"]),
        rule("format_usage", F.coalesce(f["usage_count"] < 0, F.lit(True)), f["style_id"]),
        rule("format_sample", f["sample"].isNull() | _text(f["sample"], 4096, True), f["style_id"]),
        rule("format_numbered", f["numbered"].isNull(), f["style_id"]),
        rule("format_text", any_of([_text(f[n], 1024, True) for n in _OPTIONAL_TEXTS]), f["style_id"]),
        rule("format_number", any_of([endless(n) for n in numbers]), f["style_id"]),
        rule("format_start", ~f["numbering_start"].between(0, 32767), f["style_id"]),
        rule("format_level", any_of([~lv.between(0, 8) for lv in levels]), f["style_id"]),
        rule("format_stories", story_bad, f["style_id"]),
        rule(
            "format_aliases",
            _aliases_bad(f["font_latin_aliases"]) | _aliases_bad(f["font_east_asia_aliases"]),
            f["style_id"],
        ),
    ]


def manifest_rules(manifests: DataFrame) -> DataFrame:
    """Schema rules of pack manifests.

    ``manifests`` has ``pack_id, manifest`` (parsed). A value of the wrong type
    parses to NULL and shows up as missing.
    """
    m = F.col("manifest")
    negative = lambda c: F.coalesce(c < 0, F.lit(False))
    missing_or_negative = lambda c: F.coalesce(c < 0, F.lit(True))
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    counters = ("inferred_style_count", "custom_style_count", "defined_style_count", "hidden_style_count")
    required_counts = [m["manual_formatting"][n] for n in ("paragraph_count", "run_count")] + [
        m["document_summary"][n] for n in ("paragraph_count", "run_count", "table_count", "section_count")
    ]
    integer = lambda v: lenient_int(v).between(-(2**31), 2**31 - 1)
    ind_ok = lambda i: (F.size(i) > 0) & F.forall(
        F.map_entries(i), lambda e: e["key"].isin(*R.INDENT_ATTRS) & F.coalesce(integer(e["value"]), F.lit(False))
    )
    spacing_ok = lambda s: (F.size(s) > 0) & F.forall(
        F.map_entries(s),
        lambda e: F.coalesce(
            (e["key"].isin(*R.SPACING_INT_ATTRS) & integer(e["value"]))
            | (e["key"].isin(*R.SPACING_FLAG_ATTRS) & on_off(e["value"]).isNotNull())
            | ((e["key"] == "lineRule") & e["value"].isin(*R.LINE_RULES)),
            F.lit(False),
        ),
    )

    def profile_ok(p: Column) -> Column:
        some = p["ind"].isNotNull() | p["spacing"].isNotNull() | p["jc"].isNotNull()
        fine = lambda value, test: value.isNull() | F.coalesce(test, F.lit(False))
        return (
            some
            & fine(p["ind"], ind_ok(p["ind"]))
            & fine(p["spacing"], spacing_ok(p["spacing"]))
            & fine(p["jc"], p["jc"].isin(*R.ALIGNMENTS))
        )

    lists = ("inferred_heading_styles", "heading_numbering_conflicts", "heading_completion_warnings")
    list_bad = lambda a: F.coalesce(F.exists(a, lambda s: s.isNull() | _text(s, 1024, True)), F.lit(False))
    tables = m["used_table_styles"]
    whole = manifests.select(
        "pack_id",
        broken(
            [
                rule("schema_version", ~m["schema_version"].eqNullSafe(R.PACK_SCHEMA_VERSION)),
                rule("id", _text(m["id"], 128), m["id"]),
                rule("name", _text(m["name"], 512), m["name"]),
                rule("used_formats", m["used_formats"].isNull()),
                rule("used_table_styles", tables.isNull() | list_bad(tables)),
                rule("repeated_table_style", F.size(F.array_distinct(tables)) < F.size(tables)),
                rule("used_style_count", missing_or_negative(m["used_style_count"])),
                rule("format_part_count", missing_or_negative(m["format_part_count"])),
                rule("style_counts", any_of([negative(m[c]) for c in counters])),
                rule("counts", any_of([missing_or_negative(c) for c in required_counts])),
                rule("page_layout", m["page_layout"].isNull()),
                rule("orientation", _text(m["page_layout"]["orientation"], 32, True)),
                rule("privacy", F.exists(F.map_entries(m["privacy"]), lambda e: _text(e["key"], 128) | e["value"].isNull())),
                rule("text_list", any_of([list_bad(m[n]) for n in lists])),
                rule("created_at", _text(m["created_at"], 1024, True)),
                rule("preferred_table", _text(m["preferred_table_style"], 255, True)),
                rule(
                    "authorities",
                    F.exists(F.map_entries(m["heading_authorities"]), lambda e: _text(e["key"], 8) | _text(e["value"], 255)),
                ),
                rule(
                    "saved_indents",
                    F.exists(
                        F.map_entries(m["heading_paragraph_indents"]),
                        lambda e: _text(e["key"], 255) | ~F.coalesce(ind_ok(e["value"]), F.lit(False)),
                    ),
                ),
                rule(
                    "saved_properties",
                    F.exists(
                        F.map_entries(m["heading_paragraph_properties"]),
                        lambda e: _text(e["key"], 255) | ~profile_ok(e["value"]),
                    ),
                ),
                rule(
                    "layout_list",
                    F.exists(m["section_layouts"], lambda s: s.isNull() | list_bad(s)),
                ),
            ]
        ),
    )
    formats = manifests.select("pack_id", F.explode("manifest.used_formats").alias("f"))
    single = formats.select("pack_id", broken(_format_rules(F.col("f"))))
    twice = (
        formats.groupBy("pack_id", "f.type", "f.style_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("pack_id", F.lit("repeated_format").alias("rule"), F.col("style_id").alias("detail"))
    )
    roles = F.array(
        F.struct(F.col("f.font_latin").alias("font"), F.col("f.font_latin_aliases").alias("aliases")),
        F.struct(F.col("f.font_east_asia").alias("font"), F.col("f.font_east_asia_aliases").alias("aliases")),
    )
    spelled = (
        formats.select("pack_id", "f.type", "f.style_id", F.posexplode(roles).alias("role", "r"))
        .select("pack_id", "type", "style_id", "role", F.col("r.font").alias("font"), F.explode("r.aliases").alias("alias"))
        .withColumn("key", alias_key(F.col("alias")))
        .withColumn("own", alias_key(F.col("font")))
    )
    repeated_alias = (
        spelled.groupBy("pack_id", "type", "style_id", "role", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("key").eqNullSafe(F.col("own"))).alias("own"))
        .filter("n > 1 OR own")
        .select(
            "pack_id",
            F.when(F.col("own"), F.lit("alias_is_font")).otherwise(F.lit("repeated_alias")).alias("rule"),
            F.col("style_id").alias("detail"),
        )
    )
    return whole.unionByName(single).unionByName(twice).unionByName(repeated_alias)


def edit_rules(edits: DataFrame) -> DataFrame:
    """Domain of edit requests in long form.

    ``edits`` has ``pack_id, style_id, field, value, seq``; optional ``level``
    (heading level of the style) for pattern checks.
    """
    field, value = F.col("field"), F.trim(F.col("value"))
    number = value.try_cast("double")
    tests = []
    for name, (low, high, step) in R.EDIT_RANGES.items():
        mine = field == name
        good = number.between(low, high) & on_step(number, step)
        tests.append(rule("range", mine & ~F.coalesce(good, F.lit(False)), field))
    choices = {
        "alignment": R.ALIGNMENTS,
        "line_rule": R.LINE_RULES,
        "numbering_format": R.NUMBER_FORMATS,
        "table_border_style": R.BORDER_STYLES,
    }
    for name, allowed in choices.items():
        tests.append(rule("choice", (field == name) & ~F.coalesce(value.isin(*allowed), F.lit(False)), field))
    for name in ("color_hex", "table_fill_hex", "table_accent_hex", "table_border_color_hex"):
        tests.append(rule("color", (field == name) & ~F.coalesce(value.rlike("^#?[0-9A-Fa-f]{6}$"), F.lit(False)), field))
    for name in ("bold", "numbering_restart"):
        tests.append(rule("flag", (field == name) & ~F.coalesce(value.isin("true", "false"), F.lit(False)), field))
    for name, longest in (("font_latin", 127), ("font_east_asia", 127), ("numbering_pattern", 128)):
        bad = (F.coalesce(value, F.lit("")) == "") | (F.length(value) > longest) | has_control(value)
        tests.append(rule("text", (field == name) & bad, field))
    tests.append(rule("unknown_field", ~field.isin(*R.EDIT_FIELDS), field))
    if "level" in edits.columns:
        fault = pattern_fault(value, F.col("level"))
        tests.append(rule("pattern", (field == "numbering_pattern") & fault.isNotNull(), fault))
        tests.append(
            rule("top_restart", (field == "numbering_restart") & (value == "true") & (F.col("level") == 0), field)
        )
    single = edits.select("pack_id", "style_id", broken(tests))

    given = lambda *names: reduce(lambda a, b: a | b, [F.array_contains("fields", n) for n in names])
    first_value = lambda *names: F.coalesce(*[F.try_element_at("values", F.lit(n)) for n in names]).try_cast("double")
    both = lambda a, b: given(a) & given(b)
    sides = ("left", "right", "first_line", "hanging")
    mixed = reduce(lambda a, b: a | b, [both(f"{s}_indent_pt", f"{s}_indent_chars") for s in sides])
    first = first_value("first_line_indent_pt", "first_line_indent_chars")
    hang = first_value("hanging_indent_pt", "hanging_indent_chars")
    raw_line = first_value("line_spacing")
    auto = F.try_element_at("values", F.lit("line_rule")) == "auto"
    line_ok = F.when(auto, raw_line.between(0.5, 10.0) & on_step(raw_line, 0.01)).otherwise(
        raw_line.between(1.0, 1584.0) & on_step(raw_line, 0.05)
    )
    grouped = (
        edits.groupBy("pack_id", "style_id", "field")
        .agg(F.max_by("value", "seq").alias("value"), F.count(F.lit(1)).alias("n"))
        .groupBy("pack_id", "style_id")
        .agg(
            F.collect_set("field").alias("fields"),
            F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("values"),
            F.max("n").alias("n"),
        )
        .select(
            "pack_id",
            "style_id",
            broken(
                [
                    rule("repeated_field", F.col("n") > 1),
                    rule("line_pair", given("line_spacing") != given("line_rule")),
                    rule("line_spacing", both("line_spacing", "line_rule") & ~F.coalesce(line_ok, F.lit(False))),
                    rule("mixed_units", mixed),
                    rule("both_indents", (F.abs(first) > 1e-9) & (F.abs(hang) > 1e-9)),
                ]
            ),
        )
    )
    crowded = (
        edits.select("pack_id", "style_id")
        .distinct()
        .groupBy("pack_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > R.MAX_EDIT_STYLES)
        .select(
            "pack_id",
            F.lit(None).cast("string").alias("style_id"),
            F.lit("style_count").alias("rule"),
            F.col("n").cast("string").alias("detail"),
        )
    )
    return single.unionByName(grouped).unionByName(crowded)


def integrity_rules(packs: DataFrame, differences: DataFrame) -> DataFrame:
    """Integrity of packs: hashes, fingerprint, part count, schema version.

    ``packs`` has declared and computed values; ``differences`` comes from
    ``library.reconcile``.
    """
    declared, computed = F.col("declared_fingerprint"), F.col("fingerprint")
    whole = packs.select(
        "pack_id",
        broken(
            [
                rule("schema_version", ~F.col("schema_version").eqNullSafe(R.PACK_SCHEMA_VERSION)),
                rule("fingerprint", declared.isNotNull() & ~declared.eqNullSafe(computed), declared),
                rule("part_count", ~F.col("declared_parts").eqNullSafe(F.col("part_count")), F.col("part_count")),
            ]
        ),
    )
    parts = differences.select("pack_id", "rule", F.col("name").alias("detail"))
    return whole.unionByName(parts)


def layout_rules(layouts: DataFrame) -> DataFrame:
    """Stored section layouts: readable base64, bounded, an allowed Word tag and no
    attribute of the relationship namespace, whatever its prefix.

    ``layouts`` has ``pack_id, idx, encoded``.
    """
    rows = layouts.select("pack_id", "idx", F.try_to_binary("encoded", F.lit("base64")).alias("raw"))
    ddl = f"pack_id {dict(rows.dtypes)['pack_id']}, idx {dict(rows.dtypes)['idx']}, size bigint, parsed boolean, tag string, word boolean, hooks int"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pack_id, idx, raw in zip(*(c.to_pylist() for c in batch.columns)):
                row = {"pack_id": pack_id, "idx": idx, "size": None if raw is None else len(raw)}
                if raw is not None and len(raw) <= R.MAX_PACK_MEMBER_BYTES:
                    row |= _layout(raw)
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(read, ddl).select(
        "pack_id",
        broken(
            [
                rule("layout_base64", F.col("size").isNull(), F.col("idx")),
                rule("layout_size", F.col("size") > R.MAX_PACK_MEMBER_BYTES, F.col("idx")),
                rule("layout_xml", ~F.col("parsed"), F.col("idx")),
                rule("layout_tag", F.col("parsed") & ~(F.col("word") & F.col("tag").isin(*R.SECTION_TAGS)), F.col("tag")),
                rule("layout_hook", F.col("hooks") > 0, F.col("tag")),
            ]
        ),
    )


def _layout(raw: bytes) -> dict:
    """Tag, whether it is a Word tag, and relationship attributes in the whole element."""
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        return {"parsed": False}
    space, _, tag = root.tag.rpartition("}")
    hooks = sum(name.startswith("{" + R.OFFICE_REL + "}") for node in root.iter() for name in node.attrib)
    return {"parsed": True, "tag": tag, "word": space == "{" + R.WORD, "hooks": hooks}


def infeasible_demotions(used: DataFrame, authority: DataFrame) -> DataFrame:
    """Targets whose headings cannot move down one level under a pack.

    ``used`` has ``pkg_id, pack_id, levels``; ``authority`` ``pack_id, levels``.
    Levels below the third can be generated when the first three exist.
    """
    wanted = F.array_distinct(F.transform("levels", lambda k: F.least(F.lit(8), k + 1)))
    have = F.coalesce("have", F.array().cast("array<int>"))
    missing = F.array_except(wanted, have)
    top = F.size(F.array_intersect(have, F.array(F.lit(0), F.lit(1), F.lit(2)))) == 3
    deepest = F.array_max(missing)
    made = F.when(top & (deepest >= 3), F.sequence(F.lit(3), F.greatest(deepest, F.lit(3)))).otherwise(
        F.array().cast("array<int>")
    )
    return (
        used.join(authority.select("pack_id", F.col("levels").alias("have")), "pack_id", "left")
        .withColumn("unresolved", F.array_sort(F.array_except(missing, made)))
        .withColumn("inferred", F.array_sort(F.array_except(made, have)))
        .drop("have")
    )


def rejects(violations: DataFrame, key: str) -> DataFrame:
    """Entities with at least one violation."""
    return violations.select(key).distinct()
