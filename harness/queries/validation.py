"""Validation rule sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.operators import library, quality, usage
from galley.registries import OFFICE_REL, WORD
from galley.sources.packs import parse_manifests
from harness import adapters as A
from harness.queries.aggregates import HEADED_NEEDS, LEVELED, leveled
from harness.registry import query

MIB = 1024 * 1024


def per_rule(violations, key):
    return violations.groupBy(key, "rule").agg(F.count(F.lit(1)).alias("n"))


HOSTILE = {
    "name": "CASE WHEN n_chars % 31 = 0 THEN '/abs.xml' WHEN n_chars % 29 = 0 THEN concat('media/', CAST(n_chars AS STRING), '.bin') ELSE concat('word/part', CAST(n_chars % 900 AS STRING), '.xml') END",
    "file_size": "CAST(n_chars * 20000 AS BIGINT)",
    "compress_size": "CAST(floor(n_chars * 20000 / (1 + n_chars % 2000)) AS BIGINT)",
    "compress_type": "CASE WHEN n_chars % 10 = 0 THEN 12 ELSE 8 END",
    "flag_bits": "CASE WHEN n_chars % 17 = 0 THEN 1 ELSE 0 END",
    "is_dir": "n_chars % 23 = 0",
}
HOSTILE_SQL = "SELECT source AS pkg_id, " + ", ".join(f"{v} AS {k}" for k, v in HOSTILE.items()) + " FROM documents"


def hostile(spark, d):
    rows = A.docs(spark, d)
    return rows.select(F.col("source").alias("pkg_id"), *[F.expr(v).alias(k) for k, v in HOSTILE.items()])


@query(
    "v1_package_limits", [],
    f"""WITH m AS ({HOSTILE_SQL}), r AS (
        SELECT pkg_id, 'unsafe_name' AS rule FROM m WHERE name = '/abs.xml' UNION ALL SELECT pkg_id, 'encrypted' FROM m WHERE flag_bits = 1
        UNION ALL SELECT pkg_id, 'compression' FROM m WHERE compress_type = 12 UNION ALL SELECT pkg_id, 'full_folder' FROM m WHERE is_dir AND file_size <> 0
        UNION ALL SELECT pkg_id, 'member_size' FROM m WHERE NOT is_dir AND file_size > {512 * MIB} UNION ALL SELECT pkg_id, 'xml_size' FROM m WHERE NOT is_dir AND name LIKE '%.xml' AND file_size > {64 * MIB}
        UNION ALL SELECT pkg_id, 'ratio' FROM m WHERE NOT is_dir AND file_size >= {MIB} AND file_size > compress_size * 1000
        UNION ALL SELECT pkg_id, 'member_count' FROM m GROUP BY pkg_id HAVING count(*) > 50
        UNION ALL SELECT pkg_id, 'total_size' FROM m GROUP BY pkg_id HAVING sum(CASE WHEN is_dir THEN 0 ELSE file_size END) > {1024 * MIB}
        UNION ALL SELECT pkg_id, 'repeated_name' FROM m GROUP BY pkg_id, name HAVING count(*) > 1)
        SELECT pkg_id, rule, count(*) AS n FROM r GROUP BY ALL""",
)
def v1(spark, d):
    return per_rule(quality.package_rules(hostile(spark, d), max_members=50), "pkg_id")


REL = {
    "rel_id": "CASE WHEN ord % 11 = 10 THEN '' ELSE concat('r', CAST(ord AS STRING)) END",
    "rel_type": "CASE WHEN length(text) % 4 = 0 THEN 'http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles' "
    "WHEN length(text) % 4 = 1 THEN 'http://schemas.openxmlformats.org/officeDocument/2006/relationships/theme' ELSE 'urn:other' END",
    "target": "CASE WHEN length(text) % 5 = 0 THEN 'styles.xml' WHEN length(text) % 5 = 1 THEN concat('p', CAST(ord AS STRING), '.xml') WHEN length(text) % 5 = 2 THEN '../../x.xml' "
    "WHEN length(text) % 5 = 3 THEN 'media/a?b.png' ELSE 'gone.xml' END",
    "target_mode": "CASE WHEN length(text) % 6 = 0 THEN 'External' END",
}


@query(
    "v2_relationship_contract", ["line"],
    f"""WITH m AS (SELECT pkg_id, ord, {", ".join(f"{v} AS {k}" for k, v in REL.items())} FROM line),
        p AS (SELECT *, CASE WHEN target LIKE '../../%' THEN NULL ELSE 'word/' || target END AS part, regexp_extract(rel_type, '([^/]*)$', 1) AS role FROM m),
        r AS (SELECT pkg_id, 'rel_type' AS rule FROM p WHERE rel_type = 'urn:other' UNION ALL SELECT pkg_id, 'rel_blank' FROM p WHERE rel_id = ''
        UNION ALL SELECT pkg_id, 'rel_external' FROM p WHERE target_mode = 'External' UNION ALL SELECT pkg_id, 'rel_path' FROM p WHERE target LIKE '%?%'
        UNION ALL SELECT pkg_id, 'rel_target' FROM p WHERE part IS NULL OR part NOT LIKE '%.xml' UNION ALL SELECT pkg_id, 'rel_dangling' FROM p WHERE part = 'word/gone.xml'
        UNION ALL SELECT pkg_id, 'rel_role_twice' FROM p GROUP BY pkg_id, role HAVING count(*) > 1 UNION ALL SELECT pkg_id, 'rel_id_twice' FROM p GROUP BY pkg_id, rel_id HAVING count(*) > 1
        UNION ALL SELECT pkg_id, 'rel_part_twice' FROM p GROUP BY pkg_id, part HAVING count(*) > 1
        UNION ALL SELECT pkg_id, 'no_style_part' FROM p GROUP BY pkg_id HAVING NOT bool_or(coalesce(role = 'styles' AND part = 'word/styles.xml', false)))
        SELECT pkg_id, rule, count(*) AS n FROM r GROUP BY ALL""",
)
def v2(spark, d):
    rels = A.lines(spark, d).select("pkg_id", "ord", *[F.expr(v).alias(k) for k, v in REL.items()])
    parts = rels.select("pkg_id", F.concat(F.lit("word/"), "target").alias("part")).filter("part LIKE '%.xml' AND part NOT LIKE '%gone%'")
    return per_rule(quality.relationship_rules(rels, parts), "pkg_id")


@query(
    "v2_format_tags", [],
    r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|p|li|a|b|title)\b', 1)) AS tag, generate_subscripts(regexp_extract_all(html, '<(h1|p|li|a|b|title)\b', 1), 1) AS pos FROM pages),
       r AS (SELECT page_id AS pkg_id, 'root_tag' AS rule FROM t WHERE pos = 1 UNION ALL SELECT page_id, 'forbidden_tag' FROM t WHERE tag = 'p' UNION ALL SELECT page_id, 'relationship_attribute' FROM t WHERE tag = 'a')
       SELECT pkg_id, rule, count(*) AS n FROM r GROUP BY ALL""",
)
def v2_tags(spark, d):
    found = F.regexp_extract_all("html", F.lit(r"<(h1|p|li|a|b|title)\b"), F.lit(1))
    tags = A.table(spark, d, "pages").select(F.col("page_id").alias("pkg_id"), F.posexplode(found).alias("pos", "tag"))
    rows = tags.select(
        "pkg_id", F.lit("styles").alias("role"), "tag", (F.col("pos") == 0).alias("is_root"), F.lit(False).alias("is_top"), F.when(F.col("tag") == "a", 1).otherwise(0).alias("rel_attrs")
    )
    return per_rule(quality.tag_rules(rows), "pkg_id")


@query(
    "v2_content_types", ["line"],
    """WITH t AS (SELECT pkg_id, CASE WHEN ord % 2 = 0 THEN 'Default' ELSE 'Override' END AS kind, CASE WHEN ord % 2 = 0 THEN CASE WHEN length(text) % 3 = 0 THEN 'XML' ELSE 'png' END ELSE 'p' || ord END AS key,
         length(text) % 4 = 0 AS themed, ord % 2 = 0 AS dflt, length(text) % 3 = 0 AS xml FROM line),
       r AS (SELECT pkg_id, 'content_type' AS rule FROM t WHERE (dflt AND NOT xml) OR (NOT dflt AND NOT themed) UNION ALL SELECT pkg_id, 'content_type_twice' FROM t GROUP BY pkg_id, kind, lower(key) HAVING count(*) > 1)
       SELECT pkg_id, rule, count(*) AS n FROM r GROUP BY ALL""",
)
def v2_types(spark, d):
    n, even = F.length("text"), F.col("ord") % 2 == 0
    rows = A.lines(spark, d).select(
        "pkg_id", F.when(even, F.lit("Default")).otherwise(F.lit("Override")).alias("kind"),
        F.when(even, F.when(n % 3 == 0, F.lit("XML")).otherwise(F.lit("png"))).otherwise(F.concat(F.lit("p"), F.col("ord").cast("string"))).alias("key"),
        F.when(n % 4 == 0, F.lit("theme")).otherwise(F.lit("styles")).alias("role"),
        F.when(even, F.lit("application/xml")).otherwise(F.lit("application/vnd.openxmlformats-officedocument.theme+xml")).alias("content_type"),
    )
    return per_rule(quality.content_type_rules(rows), "pkg_id")


def manifests(spark, d):
    n = F.col("n_chars")
    fmt = F.struct(
        F.when(n % 7 == 0, F.lit("")).otherwise(F.lit("H1")).alias("style_id"), F.lit("Name").alias("name"), F.when(n % 5 == 0, F.lit("shape")).otherwise(F.lit("paragraph")).alias("type"),
        (n - 500).alias("usage_count"), F.lit("").alias("sample"), F.lit(True).alias("numbered"), (n % 12).alias("outline_level"),
        F.lit("Arial").alias("font_latin"), F.array(F.when(n % 4 == 0, F.lit("ARIAL")).otherwise(F.lit("Helvetica")), F.lit("Sans")).alias("font_latin_aliases"),
    )
    counts = F.struct(F.lit(1).alias("paragraph_count"), F.lit(1).alias("run_count"), F.lit(0).alias("table_count"), F.when(n % 3 != 0, F.lit(1)).alias("section_count"))
    body = F.struct(
        F.when(n % 6 == 0, F.lit(2)).otherwise(F.lit(1)).alias("schema_version"), F.col("pkg_id").cast("string").alias("id"), F.when(n % 8 != 0, F.col("source")).alias("name"),
        F.when(n % 9 == 0, F.array(fmt, fmt)).otherwise(F.array(fmt)).alias("used_formats"), F.array(F.lit("T1"), F.when(n % 10 == 0, F.lit("T1")).otherwise(F.lit("T2"))).alias("used_table_styles"),
        F.lit(1).alias("used_style_count"), F.lit(5).alias("format_part_count"), counts.alias("manual_formatting"), counts.alias("document_summary"), F.struct(F.lit(21.0).alias("width_cm")).alias("page_layout"),
        F.create_map(F.lit("H1"), F.struct(F.create_map(F.when(n % 11 == 0, F.lit("odd")).otherwise(F.lit("left")), F.lit("0")).alias("ind"))).alias("heading_paragraph_properties"),
    )
    return parse_manifests(A.docs(spark, d).select(F.col("pkg_id").alias("pack_id"), F.to_json(body).alias("json")))


@query(
    "v3_manifest_schema", ["doc"],
    """WITH m AS (SELECT pkg_id AS pack_id, n_chars AS n, unnest(range(CASE WHEN n_chars % 9 = 0 THEN 2 ELSE 1 END)) AS i FROM doc),
       r AS (SELECT pack_id, 'schema_version' AS rule FROM m WHERE i = 0 AND n % 6 = 0 UNION ALL SELECT pack_id, 'name' FROM m WHERE i = 0 AND n % 8 = 0
       UNION ALL SELECT pack_id, 'repeated_table_style' FROM m WHERE i = 0 AND n % 10 = 0 UNION ALL SELECT pack_id, 'counts' FROM m WHERE i = 0 AND n % 3 = 0
       UNION ALL SELECT pack_id, 'saved_properties' FROM m WHERE i = 0 AND n % 11 = 0 UNION ALL SELECT pack_id, 'format_id' FROM m WHERE n % 7 = 0 UNION ALL SELECT pack_id, 'format_type' FROM m WHERE n % 5 = 0
       UNION ALL SELECT pack_id, 'format_usage' FROM m WHERE n < 500 UNION ALL SELECT pack_id, 'format_level' FROM m WHERE n % 12 > 8 UNION ALL SELECT pack_id, 'repeated_format' FROM m WHERE i = 1
       UNION ALL SELECT pack_id, 'alias_is_font' FROM m WHERE i = 0 AND n % 4 = 0 UNION ALL SELECT pack_id, 'repeated_alias' FROM m WHERE i = 1 UNION ALL SELECT pack_id, 'repeated_alias' FROM m WHERE i = 1 AND n % 4 <> 0)
       SELECT pack_id, rule, count(*) AS n FROM r GROUP BY ALL""",
)
def v3(spark, d):
    return per_rule(quality.manifest_rules(manifests(spark, d)), "pack_id")


EDIT_FIELD = (
    "CASE event_id % 8 WHEN 0 THEN 'size_pt' WHEN 1 THEN 'space_before_pt' WHEN 2 THEN 'alignment' WHEN 3 THEN 'color_hex' WHEN 4 THEN 'bold' WHEN 5 THEN 'odd_field' "
    "WHEN 6 THEN 'numbering_pattern' ELSE 'left_indent_chars' END"
)
EDIT_VALUE = (
    "CASE event_id % 8 WHEN 2 THEN event_type WHEN 3 THEN substr(md5(props), 1, 5 + CAST(event_id % 3 AS INT)) WHEN 4 THEN CASE WHEN event_type = 'view' THEN 'true' ELSE 'yes' END "
    "WHEN 6 THEN CASE event_type WHEN 'view' THEN '%1.%2' WHEN 'click' THEN '%1' WHEN 'error' THEN '%2%x' WHEN 'signup' THEN '%2.%3' ELSE 'none' END ELSE CAST(CAST(round(value * 100) AS BIGINT) / 100.0 AS STRING) END"
)


@query(
    "v4_edit_domain", [],
    f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS pack_id, event_type AS style_id, {EDIT_FIELD} AS field, {EDIT_VALUE} AS value, CAST(round(value * 100) AS BIGINT) AS c, event_type, event_id % 8 AS f FROM events),
        r AS (SELECT pack_id, 'range' AS rule FROM e WHERE (f = 0 AND (c NOT BETWEEN 500 AND 20000 OR c % 50 <> 0)) OR (f = 1 AND (c NOT BETWEEN 0 AND 158400 OR c % 5 <> 0)) OR (f = 7 AND c NOT BETWEEN -10000 AND 10000)
        UNION ALL SELECT pack_id, 'choice' FROM e WHERE f = 2 UNION ALL SELECT pack_id, 'color' FROM e WHERE f = 3 AND length(value) <> 6 UNION ALL SELECT pack_id, 'flag' FROM e WHERE f = 4 AND value = 'yes'
        UNION ALL SELECT pack_id, 'unknown_field' FROM e WHERE f = 5 UNION ALL SELECT pack_id, 'pattern' FROM e WHERE f = 6 AND event_type <> 'view'
        UNION ALL SELECT pack_id, 'repeated_field' FROM (SELECT pack_id, style_id FROM e GROUP BY pack_id, style_id, field HAVING count(*) > 1) GROUP BY pack_id, style_id)
        SELECT pack_id, rule, count(*) AS n FROM r GROUP BY ALL""",
)
def v4(spark, d):
    rows = A.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("pack_id"), F.col("event_type").alias("style_id"), F.expr(EDIT_FIELD).alias("field"),
        F.expr(EDIT_VALUE).alias("value"), F.col("event_id").alias("seq"), F.lit(1).alias("level"),
    )
    return per_rule(quality.edit_rules(rows), "pack_id")


@query(
    "v5_integrity", [],
    """WITH p AS (SELECT conv_id AS pack_id, count(*) AS n, sha256(string_agg(lpad(CAST(turn AS VARCHAR), 4, '0') || chr(0) || sha256(text) || chr(10), '' ORDER BY turn)) AS fp FROM conversations GROUP BY ALL),
       r AS (SELECT pack_id, 'schema_version' AS rule FROM p WHERE pack_id % 10 = 0 UNION ALL SELECT pack_id, 'fingerprint' FROM p WHERE pack_id % 4 = 1 UNION ALL SELECT pack_id, 'part_count' FROM p WHERE pack_id % 3 = 2
       UNION ALL SELECT conv_id, 'hash_mismatch' FROM conversations WHERE turn % 5 = 4)
       SELECT pack_id, rule, count(*) AS n FROM r GROUP BY ALL""",
)
def v5(spark, d):
    parts = library.part_hashes(
        A.turns(spark, d).select(
            F.col("pkg_id").alias("pack_id"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("name"), F.encode("text", "UTF-8").alias("content"), "turn"
        )
    )
    declared = parts.select("pack_id", "name", F.when(F.col("turn") % 5 == 4, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    packs = library.fingerprint(parts).select(
        "pack_id", "fingerprint", "part_count", F.when(F.col("pack_id") % 10 == 0, 2).otherwise(1).alias("schema_version"),
        F.when(F.col("pack_id") % 4 == 1, F.lit("x")).when(F.col("pack_id") % 4 == 2, F.col("fingerprint")).alias("declared_fingerprint"),
        F.when(F.col("pack_id") % 3 == 2, F.col("part_count") + 1).otherwise(F.col("part_count")).alias("declared_parts"),
    )
    return per_rule(quality.integrity_rules(packs, library.reconcile(declared, parts)), "pack_id")


@query(
    "v6_pack_limits", [],
    """WITH m AS (SELECT source AS pkg_id, CASE n_chars % 5 WHEN 0 THEN 'manifest.json' WHEN 1 THEN 'other/x' ELSE 'parts/word/' || doc_id || '.xml' END AS name, n_chars AS file_size FROM documents),
       r AS (SELECT pkg_id, 'unknown_entry' AS rule FROM m WHERE name = 'other/x' UNION ALL SELECT pkg_id, 'entry_size' FROM m WHERE file_size > 5000
       UNION ALL SELECT pkg_id, 'entry_count' FROM m GROUP BY pkg_id HAVING count(*) > 50 UNION ALL SELECT pkg_id, 'pack_size' FROM m GROUP BY pkg_id HAVING sum(file_size) > 150000)
       SELECT pkg_id, rule, count(*) AS n FROM r GROUP BY ALL""",
)
def v6(spark, d):
    n = F.col("n_chars")
    rows = A.docs(spark, d).select(
        F.col("source").alias("pkg_id"), n.alias("file_size"),
        F.when(n % 5 == 0, F.lit("manifest.json")).when(n % 5 == 1, F.lit("other/x")).otherwise(F.concat(F.lit("parts/word/"), F.col("pkg_id").cast("string"), F.lit(".xml"))).alias("name"),
    )
    return per_rule(quality.pack_limits(rows, 50, 5000, 150000), "pkg_id")


@query(
    "v7_stale_pairs", ["req", "doc"],
    """SELECT r.pkg_id, r.pack_id FROM req r JOIN doc d ON d.pkg_id = r.pkg_id WHERE d.n_chars % 3 <> 0 OR r.pack_id = 'delta'""",
)
def v7(spark, d):
    docs = A.docs(spark, d).select("pkg_id", "n_chars", F.sha2("text", 256).alias("target_sha256"))
    pairs = A.requests(spark, d).join(docs, "pkg_id").withColumns({"pack_sha256": F.sha2("pack_id", 256), "options": F.lit("demote")})
    known = pairs.filter("n_chars % 3 < 2").select(
        "pack_id", "pkg_id", F.when(F.col("pack_id") == "delta", F.lit("old")).otherwise(F.col("pack_sha256")).alias("pack_sha256"),
        F.when(F.col("n_chars") % 3 == 1, F.lit("old")).otherwise(F.col("target_sha256")).alias("target_sha256"), "options",
    )
    return library.stale_pairs(pairs, known).select("pkg_id", "pack_id")


@query(
    "v8_layout_rows", ["line"],
    """WITH r AS (SELECT pkg_id AS pack_id, ['layout_base64', 'layout_tag', 'layout_hook', NULL, 'layout_hook', 'layout_tag', 'layout_xml', 'layout_hook'][length(text) % 8 + 1] AS rule FROM line)
       SELECT pack_id, rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY ALL""",
)
def v8(spark, d):
    # No base64, a foreign tag, a hook, a good one, a hook under another prefix, a tag of another namespace, a cut-off tag, a hook below.
    word, rel = f'xmlns:w="{WORD}"', f'="{OFFICE_REL}"'
    samples = [
        "", f'<w:body {word} w:a="1"/>', f'<w:pgSz {word} xmlns:r{rel} r:id="x"/>', f'<?xml version="1.0"?>\n<w:pgMar {word} w:top="1"/>', f'<w:pgSz {word} xmlns:q{rel} q:embed="x"/>',
        '<w:pgSz xmlns:w="urn:other" w:a="1"/>', f'<w:pgSz {word} w:a="1"', f'<w:pgBorders {word} xmlns:z{rel}><w:top z:id="x"/></w:pgBorders>',
    ]
    n = F.length("text") % 8
    xml = F.element_at(F.array(*[F.lit(x) for x in samples]), n + 1)
    encoded = F.when(n == 0, F.lit("*no*")).otherwise(F.base64(F.encode(xml, "UTF-8")))
    rows = A.lines(spark, d).select(F.col("pkg_id").alias("pack_id"), F.col("ord").alias("idx"), encoded.alias("encoded"))
    return per_rule(quality.layout_rules(rows), "pack_id")


DEMOTION = f"""WITH l AS (SELECT DISTINCT pkg_id, level FROM ({LEVELED}) WHERE level IS NOT NULL), a AS (SELECT pack_id, list(level) AS have FROM pauth GROUP BY ALL),
    w AS (SELECT r.pkg_id, r.pack_id, a.have, list(DISTINCT least(8, l.level + 1)) AS want FROM l JOIN req r ON r.pkg_id = l.pkg_id JOIN a ON a.pack_id = r.pack_id GROUP BY ALL),
    m AS (SELECT *, list_filter(want, lambda x: NOT list_contains(have, x)) AS gone FROM w),
    g AS (SELECT *, CASE WHEN list_has_all(have, [0, 1, 2]) AND list_max(gone) >= 3 THEN range(3, list_max(gone) + 1) ELSE [] END AS made FROM m)
    SELECT pkg_id, pack_id, array_to_string(list_sort(list_filter(gone, lambda x: NOT list_contains(made, x))), ',') AS unresolved,
      array_to_string(list_sort(list_filter(made, lambda x: NOT list_contains(have, x))), ',') AS inferred FROM g"""


@query("v9_demotion_feasibility", HEADED_NEEDS + ["req", "pauth"], DEMOTION)
def v9(spark, d):
    used = usage.used_levels(leveled(spark, d)).join(A.requests(spark, d), "pkg_id")
    have = A.pack_authority(spark).groupBy(F.col("pkg_id").alias("pack_id")).agg(F.collect_set("level").alias("levels"))
    out = quality.infeasible_demotions(used, have)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("pkg_id", "pack_id", text("unresolved"), text("inferred"))
