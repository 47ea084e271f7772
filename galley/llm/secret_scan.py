"""Secret scans: patterns of known secrets, and runs of characters that are too random to be language.

Built from DataFrame expressions only; a text is read where it lies and nothing is shuffled. Candidate strings are maximal runs of
a character class. A window slides over each; how often each character stands in it is kept as counts of which a step changes two,
and with them the sum of c log2 c, so that the window's Shannon entropy, log2 W - sum / W, costs the same at every step. Windows at
or above the class's limit are joined to spans, unless the candidate is on the allow list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.common import pick

#: Known secrets: kind, pattern, least length, and the group whose length counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 12, 2), ("access", "AKIA[A-Z0-9]+", 18, 0), ("hex", "[0-9a-f]+", 16, 0))
#: Same matches, found faster: a run of fewer characters than the least contains no match of its own.
FAST = {"access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
#: Sums of c log2 c are whole millionths, so that every engine adds them alike.
UNIT = 1_000_000


@dataclass(frozen=True)
class CharClass:
    """Runs of at least ``window`` characters of ``alphabet`` that match each of ``needs``; windows of at least ``bits`` of entropy."""

    kind: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...]

    @property
    def pattern(self) -> str:
        escaped = "".join("\\" + c if c in "-+/=" else c for c in self.alphabet)
        return f"[{escaped}]{{{self.window},}}"

    @property
    def most(self) -> int:
        """The largest sum of c log2 c, in millionths, that a window of enough entropy has."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * UNIT)

    def weights(self) -> list[int]:
        return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, self.window + 1))]


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    CharClass("base64", UPPER + LOWER + DIGITS + "+/=_-", 24, 3.9, ("[A-Z]", "[a-z]", "[0-9][A-Za-z]")),
    CharClass("lower", LOWER + DIGITS, 20, 3.6, ("[g-z]", "[0-9][a-z]", "[0-9].*[0-9].*[0-9]")),
    CharClass("upper", UPPER + DIGITS, 20, 3.3, ("[G-Z]", "[0-9][A-Z]", "[0-9].*[0-9]")),
)
#: Candidates that are no secrets: ids in the public form, digests of files, runs along the alphabet, placeholders. Patterns hold no
#: repeated groups, whose matching would need a stack that grows with the candidate.
ALLOW = (
    "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    "^sha(1|256|384|512)[-=]",
    "(?i:abcdefgh|12345678|98765432|qwertyuiop)",
    "(?i:example|sample|dummy|placeholder|redacted|lorem|xxxxxx|000000)",
)


def _ends(sizes: Column, block: int = 64) -> Column:
    """Running totals of a list of numbers. Totals of blocks first, so that long lists take far fewer than all pairs of steps."""
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))
    totals = F.transform(blocks, add)
    before = lambda xs: F.transform(xs, lambda x, i: add(F.slice(xs, F.lit(1), i)))
    inner = lambda x, s: F.transform(x, lambda _, i: s + add(F.slice(x, F.lit(1), i + 1)))
    bound = F.transform(F.array(F.struct(blocks.alias("b"), totals.alias("t"))), lambda v: F.flatten(F.zip_with(v["b"], before(v["t"]), inner)))
    return F.when(F.size(sizes) > 0, bound[0]).otherwise(F.array().cast("array<bigint>"))


def matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: (s, e, x), code points from s to before e and the text between, of the leftmost matches of a pattern, in order.

    The pieces between matches and the matches alternate, so running lengths are places. Texts without a match are read once.
    """
    has = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumn("_has", has)
    df = df.withColumn("_gaps", F.when(F.col("_has"), F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("_found", F.when(F.col("_has"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    sizes = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_found")), F.col("_found"), lambda g, x: (F.length(g) + F.length(x)).cast("long"))
    df = df.withColumn("_sizes", sizes)
    df = df.withColumn("_ends", _ends(F.col("_sizes")))
    spans = F.zip_with("_found", "_ends", lambda x, e: F.struct((e - F.length(x)).alias("s"), e.alias("e"), x.alias("x")))
    return df.withColumn(out, spans).drop("_has", "_gaps", "_found", "_sizes", "_ends")


def hot_windows(candidate: Column, c: CharClass) -> Column:
    """Spans (a, b) of a candidate's characters that windows of enough entropy cover, windows that overlap or adjoin joined."""
    span = "array<struct<a:int,b:int>>"
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(c.alphabet), ch) - 1)
    weights = F.array(*[F.lit(x).cast("long") for x in c.weights()])
    zero = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.array().cast(span).alias("done")
    )

    def over(codes: Column, weights: Column) -> Column:
        def step(st: Column, i: Column) -> Column:
            full = i >= c.window
            into, out = codes[i], F.when(full, codes[F.greatest(i - c.window, F.lit(0))]).otherwise(F.lit(-1))
            # The character that leaves is taken away first; then the one that comes is added.
            n_out = F.when(full, st["n"][F.greatest(out, F.lit(0))]).otherwise(F.lit(0))
            n_in = st["n"][into] - (into == out).cast("int")
            left = F.when(full, weights[n_out] - weights[F.greatest(n_out - 1, F.lit(0))]).otherwise(F.lit(0).cast("long"))
            total = st["sum"] - left + weights[n_in + 1] - weights[n_in]
            counts = F.transform(st["n"], lambda x, k: x + (k == into).cast("int") - (k == out).cast("int"))
            hot = (i >= c.window - 1) & (total <= F.lit(c.most))
            first = i - (c.window - 1)
            joins = hot & (st["b"] >= first)
            fresh = hot & ~joins
            done = F.when(fresh & (st["a"] >= 0), F.concat(st["done"], F.array(F.struct(st["a"].alias("a"), st["b"].alias("b"))))).otherwise(st["done"])
            return F.struct(
                counts.alias("n"),
                total.alias("sum"),
                F.when(fresh, first).otherwise(st["a"]).alias("a"),
                F.when(hot, i + 1).otherwise(st["b"]).alias("b"),
                done.alias("done"),
            )

        last = lambda st: F.when(st["a"] >= 0, F.concat(st["done"], F.array(F.struct(st["a"].alias("a"), st["b"].alias("b"))))).otherwise(st["done"])
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, last)

    # A list of one binds the codes, which are then worked out once.
    return F.transform(F.array(F.struct(codes.alias("c"), weights.alias("w"))), lambda v: over(v["c"], v["w"]))[0]


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``key, *keep, text, base, added`` of every document: lists of (s, k, e, kind), code points from s to before e, by s and k.

    ``base``: leftmost matches, not overlapping within a kind, of BASE that are long enough. ``added``: what windows of high entropy
    cover, per character class; candidates that match a pattern of ``allow`` give none. k is the kind's place, base kinds first.

    Null text is empty and has no spans; repeated rows and null keys are rows like others; texts of any length are scanned whole, in
    time that grows with their length; an empty table gives no rows; other columns are ignored.
    """
    rows = pick(df, *dict.fromkeys((key, *keep, text))).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    found = []
    for k, (kind, pattern, least, group) in enumerate(BASE):
        rows = matches(rows, "_text", FAST.get(kind, pattern), f"_m{k}")
        size = (lambda x: F.length(F.regexp_extract(x, pattern, group))) if group else F.length  # noqa: B023, E731
        long = F.filter(f"_m{k}", lambda m: size(m["x"]) >= least)  # noqa: B023
        rows = rows.withColumn(f"_m{k}", F.transform(long, lambda m: _span(m["s"], k, m["e"], kind)))  # noqa: B023
        found.append(f"_m{k}")
    extra = []
    for k, c in enumerate(classes, len(BASE)):
        rows = matches(rows, "_text", c.pattern, f"_m{k}")
        fits = lambda m: _all([m["x"].rlike(n) for n in c.needs] + [~m["x"].rlike(a) for a in allow])  # noqa: B023, E731
        hot = F.transform(F.filter(f"_m{k}", fits), lambda m: F.transform(hot_windows(m["x"], c), lambda w: _span(m["s"] + w["a"], k, m["s"] + w["b"], c.kind)))  # noqa: B023
        rows = rows.withColumn(f"_m{k}", F.flatten(hot))
        extra.append(f"_m{k}")
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint,kind:string>>")
    return rows.select(key, *keep, text, F.sort_array(F.concat(*found)).alias("base"), F.sort_array(F.concat(none, *extra)).alias("added"))


def _span(start: Column, k: int, end: Column, kind: str) -> Column:
    return F.struct(start.cast("long").alias("s"), F.lit(k).alias("k"), end.cast("long").alias("e"), F.lit(kind).alias("kind"))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans``: the findings as numbers and text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    counts = [F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]  # noqa: B023
    return found.select(key, *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.sort_array(F.concat("base", "added"))).alias("spans"))
