"""Typed heading numbers and numbering patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from galley.registries import HAN_DIGITS, HAN_HEADING_UNITS, HAN_UNITS

# The shapes of a typed heading number.
_NUMBERS = r"(\d{1,3}(?:[.．]\d{1,3})*)"
_GAP = r"[ \t\x{3000}]+(?=\S)"
PAREN_PREFIX = r"^(?U)(\s*[（(]" + _NUMBERS + r"[）)]" + _GAP + ")"
PLAIN_PREFIX = r"^(?U)(\s*" + _NUMBERS + r"(?:[.．、])?" + _GAP + ")"
HAN_PREFIX = (
    r"^(?U)(\s*第([零〇一二两三四五六七八九十百千万]+)(章|篇|部|卷|节|条|款|项)" + _GAP + ")"
)


def han_number(c: Column) -> Column:
    """Value of a Chinese numeral; NULL when it is not one or not positive."""
    value = F.create_map(*[F.lit(x) for kv in {**HAN_DIGITS, **HAN_UNITS}.items() for x in kv])
    digits = F.translate(c, "".join(HAN_DIGITS), "".join(str(v) for v in HAN_DIGITS.values()))
    zero = F.struct(
        F.lit(0).cast("bigint").alias("total"),
        F.lit(0).cast("bigint").alias("section"),
        F.lit(0).cast("bigint").alias("digit"),
    )

    def state(total: Column, section: Column, digit: Column) -> Column:
        as_long = [x.cast("bigint") for x in (total, section, digit)]
        return F.struct(*[x.alias(n) for x, n in zip(as_long, ("total", "section", "digit"))])

    def read(acc: Column, ch: Column) -> Column:
        v = F.element_at(value, ch)
        nought = F.lit(0)
        block = acc["section"] + acc["digit"]
        whole = acc["total"] + F.greatest(block, F.lit(1)) * v
        part = acc["section"] + F.greatest(acc["digit"], F.lit(1)) * v
        return (
            F.when(v < 10, state(acc["total"], acc["section"], v))
            .when(v == 10000, state(whole, nought, nought))
            .otherwise(state(acc["total"], part, nought))
        )

    scaled = F.aggregate(
        F.split(c, ""), zero, read, lambda s: s["total"] + s["section"] + s["digit"]
    )
    letters = "".join(HAN_DIGITS) + "".join(HAN_UNITS)
    plain = c.rlike("^[%s]+$" % "".join(HAN_DIGITS))
    parsed = F.when(plain, digits.try_cast("bigint")).when(c.rlike("^[%s]+$" % letters), scaled)
    return F.when(parsed > 0, parsed)


def typed_shape(text: Column) -> Column:
    """Typed heading number at the start of a text, whatever the level.

    Returns ``struct(consumed, numbers, unit)``; NULL when there is none. Only
    Chinese numbers have a unit; ``numbers`` is NULL when theirs has no value.
    """

    def arabic(pattern: str) -> Column:
        parts = F.split(F.regexp_extract(text, pattern, 2), "[.．]")
        return F.struct(
            F.length(F.regexp_extract(text, pattern, 1)).alias("consumed"),
            F.transform(parts, lambda p: p.try_cast("int")).alias("numbers"),
            F.lit(None).cast("string").alias("unit"),
        )

    number = han_number(F.regexp_extract(text, HAN_PREFIX, 2)).cast("int")
    chinese = F.struct(
        F.length(F.regexp_extract(text, HAN_PREFIX, 1)).alias("consumed"),
        F.when(number.isNotNull(), F.array(number)).alias("numbers"),
        F.regexp_extract(text, HAN_PREFIX, 3).alias("unit"),
    )
    return (
        F.when(text.rlike(PAREN_PREFIX), arabic(PAREN_PREFIX))
        .when(text.rlike(PLAIN_PREFIX), arabic(PLAIN_PREFIX))
        .when(text.rlike(HAN_PREFIX), chinese)
    )


def fitted(shape: Column, level: Column) -> Column:
    """A typed number of :func:`typed_shape`, read for a heading level.

    Returns ``struct(consumed, numbers)``; NULL when there is none or its depth
    does not fit the level.
    """
    units = F.lit(False)
    for depth, letters in HAN_HEADING_UNITS.items():
        units = units | ((level == depth) & shape["unit"].isin(*letters))
    fits = F.when(shape["unit"].isNull(), F.size(shape["numbers"]) == level + 1).otherwise(units & shape["numbers"].isNotNull())
    return F.when(fits, F.struct(shape["consumed"].alias("consumed"), shape["numbers"].alias("numbers")))


def typed_prefix(text: Column, level: Column) -> Column:
    """Typed heading number at the start of a text, read for a heading level.

    Returns ``struct(consumed, numbers)``; NULL when there is none or its depth
    does not fit the level.
    """
    return F.get(F.transform(F.array(typed_shape(text)), lambda shape: fitted(shape, level)), F.lit(0))


def placeholders(pattern: Column) -> Column:
    """Levels named in a numbering pattern, in order, counted from 1."""
    found = F.regexp_extract_all(pattern, F.lit("%([1-9])"), F.lit(1))
    return F.transform(found, lambda d: d.cast("int"))


def example(level_text: Column, level: Column, start: Column) -> Column:
    """Rendering of a numbering pattern with every other level at 1."""
    ones = F.array_join(F.array_repeat(F.lit("1"), (level + 1).cast("int")), ".")
    value = F.coalesce(F.when(level_text != "", level_text), ones)
    own = F.coalesce(F.when(start != 0, start), F.lit(1)).cast("string")
    for k in range(1, 10):
        shown = F.when(level == k - 1, own).otherwise(F.lit("1"))
        value = F.replace(value, F.lit("%%%d" % k), shown)
    value = F.trim(value)
    return F.when(value != "", value)


def spells_own_path(pattern: Column, level: Column) -> Column:
    """True when a pattern names exactly its level's whole path."""
    wanted = F.sequence(F.lit(1), (level + 1).cast("int"))
    return (pattern != "") & (placeholders(pattern) == wanted)


def repeatable(pattern: Column) -> Column:
    """True when a three-level pattern can be carried on to deeper levels."""
    p1, p2, p3 = [F.instr(pattern, "%%%d" % k) for k in (1, 2, 3)]
    gap12 = F.substring(pattern, p1 + 2, p2 - p1 - 2)
    gap23 = F.substring(pattern, p2 + 2, p3 - p2 - 2)
    head = F.substring(pattern, F.lit(1), p1 - 1)
    tail = F.substring(pattern, p3 + 2, F.length(pattern))
    ordered = (p1 > 0) & (p2 > p1) & (p3 > p2)
    worded = F.lit(False)
    for piece in (head, tail, gap12):
        worded = worded | piece.rlike(r"(?U)[\w\x{3400}-\x{9fff}]")
    return F.coalesce(ordered & (gap12 != "") & (gap12 == gap23) & ~worded, F.lit(False))


def next_pattern(pattern: Column, level: Column) -> Column:
    """Pattern of the level below ``level``, continuing its separators."""
    own = F.concat(F.lit("%"), (level + 1).cast("string"))
    deeper = F.concat(F.lit("%"), (level + 2).cast("string"))
    above = F.concat(F.lit("%"), level.cast("string"))
    last = F.length(pattern) - F.instr(F.reverse(pattern), F.reverse(own))
    before = F.substring(pattern, F.lit(1), last - 1)
    gap = F.call_function("substring_index", before, above, F.lit(-1))
    has_above = (level >= 1) & (F.instr(before, above) > 0) & (gap != "")
    separator = F.when(has_above, gap).otherwise(F.lit("."))
    plain = F.array_join(
        F.transform(
            F.sequence(F.lit(1), (level + 2).cast("int")),
            lambda k: F.concat(F.lit("%"), k.cast("string")),
        ),
        ".",
    )
    known = (F.coalesce(pattern, F.lit("")) != "") & (F.instr(pattern, own) > 0)
    grown = F.concat(before, own, separator, deeper, F.substring(pattern, last + 2, F.length(pattern)))
    return F.when(known, grown).otherwise(plain)


def pattern_fault(pattern: Column, level: Column) -> Column:
    """Rule an edited numbering pattern breaks, NULL for a valid one."""
    levels = placeholders(pattern)
    own = (level + 1).cast("int")
    return (
        F.when(pattern.rlike("%(?![1-9])"), F.lit("bad_placeholder"))
        .when(F.size(levels) == 0, F.lit("no_placeholder"))
        .when(F.exists(levels, lambda k: k > own), F.lit("deeper_level"))
        .when(~F.array_contains(levels, own), F.lit("own_level_missing"))
    )
