"""Units of measurement, lenient integers and flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lenient_int(c: Column) -> Column:
    """Integer value of a string, NULL when it is not one."""
    return c.try_cast("bigint")


def twips_to_pt(c: Column) -> Column:
    return F.round(lenient_int(c) / F.lit(20.0), 2)


def twips_to_cm(c: Column) -> Column:
    return F.round(lenient_int(c) / F.lit(1440.0) * F.lit(2.54), 2)


def hundredths(c: Column) -> Column:
    return F.round(lenient_int(c) / F.lit(100.0), 2)


def half_points(c: Column) -> Column:
    return F.round(lenient_int(c) / F.lit(2.0), 1)


def eighth_points(c: Column) -> Column:
    return lenient_int(c) / F.lit(8.0)


def pt_to_twips(c: Column) -> Column:
    return F.rint(c.cast("double") * 20.0).cast("bigint")


def chars_to_hundredths(c: Column) -> Column:
    return F.rint(c.cast("double") * 100.0).cast("bigint")


def pt_to_half_points(c: Column) -> Column:
    return F.rint(c.cast("double") * 2.0).cast("bigint")


def pt_to_eighths(c: Column) -> Column:
    return F.rint(c.cast("double") * 8.0).cast("bigint")


def line_to_raw(spacing: Column, rule: Column) -> Column:
    scale = F.when(rule == "auto", F.lit(240.0)).otherwise(F.lit(20.0))
    return F.rint(spacing.cast("double") * scale).cast("bigint")


def _round_binary(c: Column) -> Column:
    """Two decimals, rounding the stored binary value half to even.

    ``format_number`` rounds the exact binary value, ``round`` its shortest
    decimal form; the two differ on values such as 18/240.
    """
    return F.replace(F.format_number(c, 2), F.lit(","), F.lit("")).cast("double")


def line_rule(line: Column, rule: Column) -> Column:
    """Effective line rule: auto when a line value comes without one."""
    given = F.when(rule != "", rule)
    return F.when(F.coalesce(line, F.lit("")) != "", F.coalesce(given, F.lit("auto"))).otherwise(rule)


def line_spacing(line: Column, rule: Column) -> Column:
    raw = lenient_int(line)
    return F.when(line_rule(line, rule) == "auto", _round_binary(raw / F.lit(240.0))).otherwise(
        F.round(raw / F.lit(20.0), 2)
    )


def hex_color(c: Column) -> Column:
    """Six hex digits in upper case, NULL for anything else."""
    cleaned = F.upper(F.regexp_replace(F.trim(c), "^#+", ""))
    return F.when(cleaned.rlike("^[0-9A-F]{6}$"), cleaned)


def on_value(bag: Column, name: str) -> Column:
    """Toggle property of a run bag: present without a value means on."""
    attrs = F.try_element_at(bag, F.lit(name))
    value = F.lower(F.trim(F.try_element_at(attrs, F.lit("val"))))
    return F.when(attrs.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.coalesce(~value.isin("0", "false", "off", "no"), F.lit(True))
    )


def on_off(c: Column) -> Column:
    """Flag attribute as "1" or "0"; unknown words give NULL."""
    value = F.lower(F.trim(c))
    return F.when(value.isin("1", "true", "on"), F.lit("1")).when(
        value.isin("0", "false", "off"), F.lit("0")
    )


def on_step(value: Column, step: float) -> Column:
    """True when a value lies on a multiple of a step."""
    steps = value.cast("double") / F.lit(step)
    nearest = F.rint(steps)
    slack = F.greatest(F.lit(1e-7), F.greatest(F.abs(steps), F.abs(nearest)) * 1e-9)
    return F.abs(steps - nearest) <= slack
