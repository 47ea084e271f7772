"""The registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import conversation_repair, decontaminate, fm_dedup, language_id, lexical_search, near_dup, outliers, packing, quality_model, secret_scan, sharding, suffix_dedup, token_counts
from galley.llm.common import shared_folder, stored

SHARDS = 16


TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS d, doc_id, {TERMS} AS t FROM documents),
docs AS (SELECT d, doc_id, len(t) AS n FROM words WHERE len(t) > 0),
sums AS (SELECT count(*)::BIGINT AS nd, coalesce(sum(n), 0)::BIGINT AS total FROM docs),
tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(t) AS term FROM words) GROUP BY d, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, sums),
asked AS (
    SELECT q, item_id, term, count(*)::BIGINT AS repeats
    FROM (SELECT q, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS q, item_id, {TERMS} AS t FROM benchmark)) GROUP BY q, item_id, term
),
scored AS (
    SELECT q, item_id, doc_id, d,
        sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // total))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (d), sums GROUP BY q, item_id, doc_id, d
),
ranked AS (SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _places(kind: str, k: int, pattern: str, size: str = "length(x.m)", least: int = 1) -> str:
    """SQL for the leftmost matches of a pattern: their places are running lengths of the pieces between and the matches."""
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT r, '{kind}' AS kind, {k} AS k, x.s AS s, x.s + length(x.m) AS e, x.m AS m FROM (
        SELECT r, unnest(list_transform(range(1, len(f) + 1), lambda i: {{
            's': coalesce(list_sum(list_transform(g[1:i], lambda y: length(y))), 0)::BIGINT + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0)::BIGINT,
            'm': f[i]}})) AS x
        FROM (SELECT r, string_split_regex(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}') AS f FROM texts)
    ) WHERE {size} >= {least}"""


def _hot(k: int, c: secret_scan.CharClass) -> str:
    """SQL for the spans of a character class: every window's sum is counted afresh, then windows are joined."""
    tests = [f"regexp_matches(m, '{n}')" for n in c.needs] + [f"NOT regexp_matches(m, '{a}')" for a in secret_scan.ALLOW]
    return f"""
    SELECT r, '{c.kind}' AS kind, {k} AS k, min(s + i) AS s, max(s + i) + {c.window} AS e FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY r, s ORDER BY i) AS island FROM (
            SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r, s ORDER BY i) + {c.window} THEN 0 ELSE 1 END AS fresh FROM (
                SELECT r, s, i, list_sum(list_transform(list_distinct(string_split(w, '')), lambda ch: round(
                    ({c.window} - length(replace(w, ch, ''))) * log2({c.window} - length(replace(w, ch, ''))) * 1000000)::BIGINT)) AS total
                FROM (SELECT r, s, i, substr(m, i::INTEGER + 1, {c.window}) AS w FROM (
                    SELECT r, s, m, unnest(range(0, length(m) - {c.window - 1})) AS i FROM ({_places(c.kind, k, c.pattern)}) WHERE {" AND ".join(tests)}))
            ) WHERE total <= {c.most}))
    GROUP BY r, s, island"""


_ASSIGN_VALUE = f"length(regexp_extract(x.m, '{secret_scan.ASSIGN.replace(chr(39), chr(39) * 2)}', 2))"
OP12_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_places(kind, k, p, _ASSIGN_VALUE if group else "length(x.m)", least) for k, (kind, p, least, group) in enumerate(secret_scan.BASE))}),
added AS ({" UNION ALL ".join(_hot(k, c) for k, c in enumerate(secret_scan.CLASSES, len(secret_scan.BASE)))}),
known AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS text
    FROM base GROUP BY r
),
every AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS text FROM (SELECT r, kind, k, s, e FROM base UNION ALL SELECT * FROM added) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(known.text, '')) AS base_sha256, coalesce(every.text, '') AS spans
FROM texts LEFT JOIN known USING (r) LEFT JOIN every USING (r)
"""


_WAYS = {"s": ((1, 2),), "u": ((1, 3), (2, 3), (4, 3)), "a": ((3, 4),)}
#: For each state of the grammar the state after an inserted or re-labelled row, and its name.
_TO = {1: (3, "user"), 2: (3, "user"), 3: (4, "assistant"), 4: (3, "user")}


def _kept(g: int) -> str:
    ways = [(role, to) for role, pairs in _WAYS.items() for at, to in pairs if at == g]
    cases = " ".join(f"WHEN initial = '{role}' THEN {{'c': late + v[{to}].c, 'a': 'K' || v[{to}].a, 't': list_prepend(role || ':' || text, v[{to}].t)}}" for role, to in ways)
    return f"CASE WHEN fault IN ('blank', 'duplicate') THEN NULL {cases} END"


def _ways(g: int) -> str:
    to, name = _TO[g]
    gone = f"{{'c': 4 + v[{g}].c, 'a': 'D' || v[{g}].a, 't': v[{g}].t}}"
    named = f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {{'c': 3 + late + v[{to}].c, 'a': 'R' || v[{to}].a, 't': list_prepend('{name}:' || text, v[{to}].t)}} END"
    return f"list_sort(list_filter([{gone}, {_kept(g)}, {named}], lambda x: x IS NOT NULL))[1]"


def _inserted(own: str, behind: str, name: str) -> str:
    return f"list_sort([{own}, {{'c': 3 + {behind}.c, 'a': 'I' || {behind}.a, 't': list_prepend('{name}:', {behind}.t)}}])[1]"


OP13_SQL = f"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
),
keyed AS (
    SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name, coalesce(conv_id::VARCHAR, 'none') AS k FROM conversations
),
kinds AS (
    SELECT k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS kind
    FROM keyed, crc
),
damaged AS (
    SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds
),
ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
placed AS (
    SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS again,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
    FROM ordered
),
faulty AS (
    SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY k ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS odd
    FROM placed
),
counts AS (
    SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n
    FROM faulty GROUP BY k
),
best AS (
    SELECT k, n + 1 AS i, [{{'c': 0, 'a': '', 't': []::VARCHAR[]}}, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}}, {{'c': 3, 'a': 'I', 't': ['assistant:']}}, {{'c': 0, 'a': '', 't': []::VARCHAR[]}}] AS v
    FROM counts
    UNION ALL
    SELECT k, i, [{_inserted("b[1]", "late3", "user")}, {_inserted("b[2]", "late3", "user")}, late3, {_inserted("b[4]", "b[3]", "user")}] AS v FROM (
        SELECT k, i, b, {_inserted("b[3]", "b[4]", "assistant")} AS late3 FROM (
            SELECT k, i, [{", ".join(_ways(g) for g in (1, 2, 3, 4))}] AS b
            FROM (SELECT best.k, f.i, v, fault, initial, role, text, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM best JOIN faulty f ON f.k = best.k AND f.i = best.i - 1)))
),
found AS (SELECT k, v[1] AS x FROM best WHERE i = 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(array_to_string(x.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM keyed) LEFT JOIN counts USING (k) LEFT JOIN found USING (k)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.digest(fm_dedup.without_repeats(_table(spark, sf_dir, "documents")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.without_repeats(_table(spark, sf_dir, "documents")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, then recount those with surrounding white space and take the textless ones away.

    The last batch is committed twice, as after a failure, and the first is folded into a base and repeated.
    """
    version = "byte_bpe_50k"
    rows = stored(token_counts.counted(_table(spark, sf_dir, "documents")))
    rollup = token_counts.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    load = token_counts.inserts(rows, version)
    rollup.commit("load", load)
    rollup.compact()
    changes = token_counts.revisions(rows.where("tokens <> trimmed"), version, "tokens", "trimmed")
    changes = changes.unionByName(token_counts.deletes(rows.where("trimmed = 0"), version, "trimmed"))
    for batch, delta in (("trim", changes), ("trim", changes), ("load", load)):
        rollup.commit(batch, delta)
    return rollup.totals()


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.robust_outliers(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.rendezvous(_table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return placed.withColumn("law", F.lit("key"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations")), copies="copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_near_dup": op3_near_dup,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_lexical_search": op11_lexical_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB texts of the queries that SQL can express.
ORACLES: dict[str, str] = {"op11_lexical_search": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_conversation_repair": OP13_SQL}
