"""Counters, prefixes, completion and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.functions import numerals
from galley.operators import catalog, completion, counters, lists, ordering, usage
from galley.operators.graph import settled
from harness import adapters as A
from harness.queries.aggregates import (
    HEADED,
    HEADED_NEEDS,
    STYLED,
    STYLED_NEEDS,
    VOTES,
    effective,
    headed,
    styled,
)
from harness.registry import query

N = range(9)


def counter_sql(source: str, keys: str = "pkg_id, part") -> str:
    """Closed form of the heading counter over ``l, st, typed, ord``."""
    w = f"PARTITION BY {keys} ORDER BY ord"
    g = ", ".join(f"sum(CASE WHEN l < {k} THEN 1 ELSE 0 END) OVER ({w} ROWS UNBOUNDED PRECEDING) AS g_{k}" for k in N)
    p = ", ".join(
        f"coalesce(max(CASE WHEN l = {k} THEN ord END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) > "
        f"coalesce(max(CASE WHEN l < {k} THEN ord END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS p_{k}"
        for k in N
    )
    grp = "CASE l " + " ".join(f"WHEN {k} THEN g_{k}" for k in N) + " END"
    ok = "CASE l WHEN 0 THEN true " + " ".join(
        f"WHEN {k} THEN " + " AND ".join(f"p_{j}" for j in range(k)) for k in N if k
    ) + " END"
    v = f"PARTITION BY {keys}, l, grp ORDER BY ord"
    c = ", ".join(
        f"last_value(CASE WHEN l = {k} THEN v END IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING) AS c_{k}" for k in N
    )
    path = "CASE l " + " ".join(f"WHEN {k} THEN concat_ws('.', {', '.join(f'c_{j}' for j in range(k + 1))})" for k in N) + " END"
    return f"""SELECT *, CASE WHEN ok THEN {path} END AS path FROM (SELECT *, {c} FROM (
        SELECT *, CAST(CASE WHEN ok THEN first_value(CASE WHEN l = 0 THEN coalesce(typed, st) ELSE st END) OVER ({v}) + row_number() OVER ({v}) - 1 ELSE st END AS BIGINT) AS v
        FROM (SELECT *, {grp} AS grp, {ok} AS ok FROM (SELECT *, {g}, {p} FROM ({source})))))"""


def path_text(c="path"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ".")


@query(
    "w1_heading_counter",
    ["ev"],
    f"SELECT pkg_id, ord, v AS value, path, ok FROM ({counter_sql('SELECT *, 1 AS part FROM ev')})",
)
def w1(spark, d):
    return counters.heading_counters(A.events(spark, d)).select("pkg_id", "ord", "value", path_text().alias("path"), "ok")


# Typed number of a heading, in the oracle's dialect (no look-ahead there).
TYPED = f"""SELECT *, {A.TYPED_TEXT} AS ttext FROM ({HEADED}) WHERE outline IS NOT NULL"""
GAP = r"[ \t\x{3000}]+"


def fitted_sql(rows: str) -> str:
    """Typed numbers of heading rows (``ttext, plain, l, st``) that have as many parts as their level asks for."""
    parsed = rf"""SELECT *, CASE
      WHEN NOT plain THEN NULL
      WHEN regexp_matches(ttext, '^\s*[（(]\d{{1,3}}([.．]\d{{1,3}})*[）)]{GAP}[^\s]') THEN regexp_extract(ttext, '^\s*[（(](\d{{1,3}}([.．]\d{{1,3}})*)[）)]', 1)
      WHEN regexp_matches(ttext, '^\s*\d{{1,3}}([.．]\d{{1,3}})*[.．、]?{GAP}[^\s]') THEN regexp_extract(ttext, '^\s*(\d{{1,3}}([.．]\d{{1,3}})*)', 1)
      WHEN regexp_matches(ttext, '^第三章 ') AND l = 0 THEN '3' END AS nums,
    CASE
      WHEN regexp_matches(ttext, '^\s*[（(]\d{{1,3}}([.．]\d{{1,3}})*[）)]{GAP}[^\s]') THEN length(regexp_extract(ttext, '^\s*[（(]\d{{1,3}}([.．]\d{{1,3}})*[）)]{GAP}'))
      WHEN regexp_matches(ttext, '^\s*\d{{1,3}}([.．]\d{{1,3}})*[.．、]?{GAP}[^\s]') THEN length(regexp_extract(ttext, '^\s*\d{{1,3}}([.．]\d{{1,3}})*[.．、]?{GAP}'))
      ELSE 4 END AS used
    FROM ({rows})"""
    return f"""SELECT * EXCLUDE (nums), CASE WHEN len(string_split(nums, '.')) = l + 1 THEN nums END AS nums,
    CASE WHEN l = 0 AND len(string_split(nums, '.')) = 1 THEN CAST(nums AS BIGINT) END AS typed FROM ({parsed})"""


FITTED = fitted_sql(f"SELECT *, outline AS l, CAST(1 AS BIGINT) AS st FROM ({TYPED})")
MATCHED = f"""SELECT *, coalesce(ok AND nums = path, false) AS matched FROM ({counter_sql(FITTED)})"""


def typed_headings(spark, d):
    rows = headed(spark, d).filter("outline IS NOT NULL")
    return rows.withColumn("text", F.expr(A.TYPED_TEXT)).select(
        "pkg_id", "part", "ord", "plain", "text", F.col("outline").alias("level"), F.lit(1).alias("start")
    )


def typed_rows(spark, d):
    # The typed text depends on the direct style, which the default fill changed only where it was empty.
    return counters.typed_numbers(typed_headings(spark, d))


def matched(spark, d):
    return counters.redundant_prefixes(counters.heading_counters(typed_rows(spark, d)))


@query(
    "w2_prefix_removal",
    HEADED_NEEDS,
    f"""SELECT pkg_id, part, ord, v AS value, path, matched, CASE WHEN matched THEN substr(ttext, used + 1) ELSE ttext END AS stripped FROM ({MATCHED})""",
)
def w2(spark, d):
    return matched(spark, d).select("pkg_id", "part", "ord", "value", path_text().alias("path"), "matched", "stripped")


@query(
    "w3_start_seed",
    HEADED_NEEDS,
    f"""SELECT pkg_id, typed AS seed FROM ({MATCHED}) WHERE l = 0 AND part = 'word/document.xml'
        QUALIFY row_number() OVER (PARTITION BY pkg_id ORDER BY ord) = 1 AND matched AND typed IS NOT NULL""",
)
def w3(spark, d):
    return counters.list_start(matched(spark, d))


@query(
    "w4_dual_counter",
    HEADED_NEEDS,
    f"""WITH o AS ({MATCHED}) SELECT pkg_id, part, ord, old_v AS old_value, matched, v AS new_value, path AS new_path FROM (
        {counter_sql("SELECT pkg_id, part, ord, v AS old_v, matched, least(8, l + 1) AS l, st, CAST(NULL AS BIGINT) AS typed FROM o")})""",
)
def w4(spark, d):
    rows = typed_headings(spark, d).withColumn("new_level", F.least(F.lit(8), F.col("level") + 1))
    return counters.dual_counters(rows).select(
        "pkg_id", "part", "ord", "old_value", "matched", F.col("value").alias("new_value"), path_text().alias("new_path")
    )


@query(
    "w5_first_seen",
    STYLED_NEEDS,
    f"""SELECT pkg_id, sid AS style_id, split_part(min(part || '#' || lpad(CAST(ord AS VARCHAR), 12, '0')), '#', 1) AS part,
        CAST(split_part(min(part || '#' || lpad(CAST(ord AS VARCHAR), 12, '0')), '#', 2) AS BIGINT) AS ord FROM ({STYLED}) GROUP BY ALL""",
)
def w5(spark, d):
    return (
        styled(spark, d).groupBy("pkg_id", "style_id").agg(F.min(usage.position()).alias("p"))
        .select("pkg_id", "style_id", "p.part", "p.ord")
    )


# Effective size and spacing of the sheets, per language (the outline tweak does not touch them).
TCHAIN = """tchain AS (SELECT lang, style_id, style_id AS cur, 0 AS depth FROM tpl UNION ALL
    SELECT c.lang, c.style_id, s.based_on, c.depth + 1 FROM tchain c JOIN tpl s ON s.lang = c.lang AND s.style_id = c.cur
    JOIN tpl p ON p.lang = s.lang AND p.style_id = s.based_on WHERE c.depth < 8)"""
MEASURES = """meas AS (SELECT c.lang, c.style_id,
    CAST(coalesce(arg_min(p.val, c.depth) FILTER (p.bag = 'r' AND p.prop = 'sz'), arg_min(p.val, c.depth) FILTER (p.bag = 'r' AND p.prop = 'szCs')) AS BIGINT) AS size,
    CAST(arg_min(p.val, c.depth) FILTER (p.prop = 'spacing' AND p.attr = 'before') AS BIGINT) AS before,
    CAST(arg_min(p.val, c.depth) FILTER (p.prop = 'spacing' AND p.attr = 'after') AS BIGINT) AS after
    FROM (SELECT * FROM tchain UNION ALL SELECT DISTINCT lang, style_id, '', 100 FROM tpl) c
    JOIN tprop p ON p.lang = c.lang AND p.style_id = c.cur GROUP BY ALL)"""
AUTHORITY = f"""auth AS (SELECT pkg_id, level, style_id FROM ({VOTES}) QUALIFY row_number() OVER (PARTITION BY pkg_id, level ORDER BY votes DESC, seen, style_id) = 1)"""


def deeper_sql(level: int) -> str:
    """One level of completion from columns s{k}, b{k}, a{k} of the two above."""
    i, j = level - 2, level - 1
    prior = f"coalesce(nullif(s{j}, 0), coalesce(nullif(body, 0), 22) + 2)"
    floor = "body + 1" if level == 3 else "body"
    size = (
        f"greatest(coalesce({floor}, 16), {prior} - least(greatest(CASE WHEN s{i} > {prior} THEN s{i} - {prior} ELSE 2 END, 1), 12))"
    )

    def space(c: str, low: int, step: int) -> str:
        p = f"coalesce({c}{j}, {low})"
        return f"greatest({low}, {p} + least(0, greatest(-120, coalesce({p} - {c}{i}, -{step}))))"

    return f"{size} AS s{level}, {space('b', 40, 40)} AS b{level}, {space('a', 0, 20)} AS a{level}"


@query(
    "w6_level_completion",
    HEADED_NEEDS + ["tpl", "tprop", "doc"],
    f"""WITH {TCHAIN}, {MEASURES}, {AUTHORITY},
      base AS (SELECT a.pkg_id, m.size AS body, {", ".join(f"max(k.size) FILTER (a.level = {k}) AS s{k}, max(k.before) FILTER (a.level = {k}) AS b{k}, max(k.after) FILTER (a.level = {k}) AS a{k}" for k in range(3))},
        list(DISTINCT a.level) AS levels
        FROM auth a JOIN doc d ON d.pkg_id = a.pkg_id JOIN meas k ON k.lang = d.lang AND k.style_id = a.style_id
        JOIN dflt f ON f.pkg_id = a.pkg_id AND f.style_type = 'paragraph' JOIN meas m ON m.lang = d.lang AND m.style_id = f.style_id
        GROUP BY a.pkg_id, m.size HAVING list_has_all(list(DISTINCT a.level), [0, 1, 2])),
      l3 AS (SELECT *, {deeper_sql(3)} FROM base), l4 AS (SELECT *, {deeper_sql(4)} FROM l3), l5 AS (SELECT *, {deeper_sql(5)} FROM l4)
      {" UNION ALL ".join(f"SELECT pkg_id, CAST({k} AS BIGINT) AS level, CAST(s{k} AS BIGINT) AS size, CAST(b{k} AS BIGINT) AS before, CAST(a{k} AS BIGINT) AS after FROM l5 WHERE NOT list_contains(levels, {k})" for k in (3, 4, 5))}""",
)
def w6(spark, d):
    sheet = A.styles(spark, d)
    measured, defaults = settled(completion.measures(catalog.resolve(sheet), "outline")), settled(catalog.default_styles(sheet))
    outlines = measured.filter("outline IS NOT NULL").select("pkg_id", "style_id", "outline")
    rows = styled(spark, d, defaults).join(outlines, ["pkg_id", "style_id"])
    done = completion.complete_levels(usage.heading_authority(rows), measured.drop("outline"), defaults.filter("style_type = 'paragraph'"), 5)
    return done.withColumn("level", F.col("level").cast("bigint"))


@query(
    "w7_next_pattern",
    ["line"],
    """SELECT pkg_id, ord, CASE WHEN pattern = '' THEN '%1.%2.%3.%4' ELSE
         regexp_replace(pattern, '%3', '%3' || coalesce(nullif(regexp_extract(pattern, '%2(.*)%3', 1), ''), '.') || '%4') END AS grown FROM (
       SELECT pkg_id, ord, CASE WHEN length(text) % 5 = 0 THEN '' ELSE '(%1' || substr('.-:/', 1 + length(text) % 4, 1) || '%2'
         || CASE WHEN length(text) % 7 = 0 THEN '' ELSE substr('.-:/', 1 + length(text) % 4, 1) END || '%3)' END AS pattern FROM line)""",
)
def w7(spark, d):
    pattern = F.expr(
        "CASE WHEN length(text) % 5 = 0 THEN '' ELSE concat('(%1', substr('.-:/', 1 + length(text) % 4, 1), '%2', "
        "CASE WHEN length(text) % 7 = 0 THEN '' ELSE substr('.-:/', 1 + length(text) % 4, 1) END, '%3)') END"
    )
    rows = A.lines(spark, d).select("pkg_id", "ord", pattern.alias("pattern"))
    return rows.select("pkg_id", "ord", numerals.next_pattern(F.col("pattern"), F.lit(2)).alias("grown"))


@query(
    "w7_numbering_extension",
    ["doc", "eff", "line"],
    """WITH gaps AS (SELECT d.pkg_id, d.lang, len(string_split(text, chr(10))) % 3 AS n FROM doc d),
       lv AS (SELECT pkg_id, lang, unnest(range(3, 4 + n)) AS level FROM gaps)
       SELECT pkg_id, level, CASE level WHEN 3 THEN '%1.%2.%3.%4' WHEN 4 THEN '%1.%2.%3.%4.%5' ELSE '%1.%2.%3.%4.%5.%6' END AS lvl_text,
         CAST(1320 + 360 * (level - 2) AS BIGINT) AS lft, CAST(600 AS BIGINT) AS hanging, CAST(least(4320, 1400 + 440 * (level - 2)) AS BIGINT) AS tab
       FROM lv""",
)
def w7_ext(spark, d):
    levels = effective(spark, d)
    base = A.docs(spark, d).select("pkg_id", (F.size(F.split("text", "\n")) % 3).alias("n"))
    missing = base.select("pkg_id", F.sequence(F.lit(3), F.lit(3) + F.col("n")).alias("levels"))
    rule = lambda k: F.struct(
        F.lit(k).alias("level"),
        F.struct(
            F.lit("1").alias("num_id"), F.lit(k).alias("level"), F.lit("decimal").alias("number_format"),
            F.lit(".".join(f"%{i + 1}" for i in range(k + 1))).alias("level_text"), F.lit(1).alias("start"),
        ).alias("rule"),
    )
    rules = base.select("pkg_id", F.inline(F.array(*[rule(k) for k in range(3)])))
    out = completion.extend_numbering(rules, levels, missing)
    return out.select(
        "pkg_id", F.col("level").cast("bigint").alias("level"), "lvl_text", F.col("left").alias("lft"), "hanging", "tab"
    )


FRESH_TAKEN = "['0', '1', '10']"


def wanted_lists(spark, d):
    n = A.numbering(spark, d)
    lists_ = A.par(spark, d).filter("num_id IS NOT NULL").select("pkg_id", "num_id").distinct()
    concrete = n["nums"].select("pkg_id", "num_id", "abstract_id")
    return lists_.join(concrete, ["pkg_id", "num_id"], "left")


@query(
    "w8_fresh_ids",
    ["par", "nums"],
    """WITH want AS (SELECT DISTINCT p.pkg_id, p.num_id, n.abstract_id FROM par p LEFT JOIN nums n ON n.num_id = p.num_id WHERE p.num_id IS NOT NULL),
       real AS (SELECT *, row_number() OVER (PARTITION BY pkg_id ORDER BY CAST(num_id AS BIGINT)) AS pos FROM want WHERE abstract_id IS NOT NULL AND num_id <> '0'),
       firsts AS (SELECT pkg_id, abstract_id, min(pos) AS pos FROM real GROUP BY ALL),
       given AS (SELECT *, abstract_id NOT IN ('0', '1', '10') AS free FROM firsts),
       newabs AS (SELECT g.pkg_id, g.abstract_id, CASE WHEN free THEN abstract_id ELSE
          CAST(greatest(10, coalesce(max(CASE WHEN free THEN CAST(abstract_id AS BIGINT) END) OVER w, 0))
          + count(*) FILTER (NOT free) OVER (PARTITION BY pkg_id ORDER BY pos) AS VARCHAR) END AS new_abstract_id
          FROM given g WINDOW w AS (PARTITION BY pkg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT r.pkg_id, r.num_id, CAST(20 + r.pos AS VARCHAR) AS new_num_id, r.abstract_id, a.new_abstract_id FROM real r JOIN newabs a USING (pkg_id, abstract_id)
       UNION ALL SELECT pkg_id, num_id, '0', NULL, NULL FROM want WHERE num_id = '0'""",
)
def w8(spark, d):
    used = A.docs(spark, d).select(
        "pkg_id", F.lit(20).alias("max_num"), F.array(*[F.lit(x) for x in ("0", "1", "10")]).alias("abstract_ids")
    )
    return lists.fresh_lists(wanted_lists(spark, d), used)


@query(
    "w9_content_identity",
    ["line"],
    """SELECT pkg_id, ord, upper(substr(sha256(text || '#' || ord), 1, 8)) AS identity FROM line""",
)
def w9(spark, d):
    rows = A.lines(spark, d)
    content = F.concat("text", F.lit("#"), F.col("ord").cast("string"))
    occupied = A.docs(spark, d).select("pkg_id", F.lit("00000001").alias("nsid"))
    return lists.content_identity(rows, content, occupied).withColumn("ord", F.col("ord").cast("bigint"))


@query(
    "w10_ordinals",
    [],
    """SELECT conv_id, turn, part, p AS pos FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS part,
       CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS p FROM conversations)""",
)
def w10(spark, d):
    rows = A.turns(spark, d)
    return ordering.ordinals(rows, F.split("text", "\n")).select(F.col("pkg_id").alias("conv_id"), "turn", "part", "pos")


@query(
    "w11_level_gaps",
    HEADED_NEEDS,
    f"""SELECT pkg_id, CASE WHEN list_has_all(levels, [0, 1, 2]) THEN array_to_string(list_filter([3, 4], lambda x: NOT list_contains(levels, x)), ',') END AS missing,
        list_max(levels) - list_min(levels) + 1 = len(levels) AS contiguous
        FROM (SELECT pkg_id, list(DISTINCT outline) AS levels FROM ({HEADED}) WHERE outline IS NOT NULL GROUP BY ALL)""",
)
def w11(spark, d):
    rows = headed(spark, d).filter("outline IS NOT NULL").groupBy("pkg_id").agg(F.collect_set("outline").alias("levels"))
    missing = completion.level_gaps(F.col("levels"))
    return rows.select(
        "pkg_id",
        F.array_join(F.transform(missing, lambda x: x.cast("string")), ",").alias("missing"),
        completion.contiguous(F.col("levels")).alias("contiguous"),
    )
