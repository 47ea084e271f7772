"""Names, samples and other string rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from galley.registries import BODY_NAMES, MAX_STEM


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters that case folding still changes: to one, to several."""
    changed = {x.lower(): x.casefold() for x in map(chr, range(0x110000)) if x.casefold() != x.lower()}
    single = {a: b for a, b in changed.items() if len(a) == len(b) == 1}
    return single, {a: b for a, b in changed.items() if len(a) == 1 < len(b)}


_SINGLE, _SEVERAL = _folds()


def casefold(c: Column) -> Column:
    """Full case folding: lower case, then the letters whose folding differs from it.

    Only names with a letter that folds to several go through the replacements.
    """
    folded = F.translate(F.lower(c), "".join(_SINGLE), "".join(_SINGLE.values()))
    pairs = F.transform(
        F.array(*[F.lit(a + b) for a, b in _SEVERAL.items()]),
        lambda p: F.struct(F.substring(p, 1, 1).alias("a"), F.substring(p, 2, 3).alias("b")),
    )
    every = F.aggregate(pairs, folded, lambda text, p: F.replace(text, p["a"], p["b"]))
    return F.when(folded.rlike("[%s]" % "".join(_SEVERAL)), every).otherwise(folded)


def style_key(c: Column) -> Column:
    """Style name without blanks, underscores and dashes, case folded."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s_\-–—]+", "")
    return casefold(bare)


def heading_key(c: Column) -> Column:
    """True when a style name reads "heading N" or its Chinese form."""
    return style_key(c).rlike("^(heading|标题)[1-9]$")


def human_size(c: Column) -> Column:
    mib, kib = 1024 * 1024, 1024
    return (
        F.when(c >= mib, F.format_string("%.1f MiB", c / mib))
        .when(c >= kib, F.format_string("%.1f KiB", c / kib))
        .otherwise(F.format_string("%d B", c))
    )


def file_stem(c: Column) -> Column:
    """File name stem: letters and digits kept, the rest joined by one dash."""
    dashed = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_-]", "-")
    trimmed = F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^-+|-+$", "")
    return F.when(trimmed == "", F.lit("word-format")).otherwise(F.substring(trimmed, 1, MAX_STEM))


def sample_text(style_type: Column, name: Column, outline: Column, example: Column) -> Column:
    """Generic sample shown for a style; never taken from a document."""
    low = casefold(name)
    heading = F.concat((outline + 1).cast("string"), F.lit("级标题 · "), name)
    listed = low.contains("list") | low.contains("number") | low.contains("bullet")
    return (
        F.when(style_type == "table", F.lit("表头　｜　内容　｜　数据"))
        .when(style_type == "character", F.lit("字符样式预览 · 中文 Aa 123"))
        .when(
            outline.isNotNull(),
            F.when(F.coalesce(example, F.lit("")) != "", F.concat(example, F.lit("　"), heading))
            .otherwise(heading),
        )
        .when(low.contains("header") | name.contains("页眉"), F.lit("页眉样式预览"))
        .when(low.contains("footer") | name.contains("页脚"), F.lit("页脚样式预览"))
        .when(listed | name.contains("列表"), F.lit("1. 列表项目预览"))
        .when(
            style_key(name).isin(*BODY_NAMES),
            F.lit("这是一段正文预览，用于观察字体、字号与行距。"),
        )
        .otherwise(F.lit("样式预览 · 中文 Aa 123"))
    )


def orientation(given: Column, width: Column, height: Column) -> Column:
    has_size = (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)
    return F.when(F.coalesce(given, F.lit("")) != "", given).when(
        has_size, F.when(width > height, F.lit("landscape")).otherwise(F.lit("portrait"))
    )


def has_control(c: Column) -> Column:
    return c.rlike(r"[\x00-\x1f\x7f]")


def theme_script(language: Column) -> Column:
    """East Asian font script of a theme language tag."""
    tags = F.filter(
        F.split(F.lower(F.replace(language, F.lit("_"), F.lit("-"))), "-"), lambda t: t != ""
    )
    primary = F.try_element_at(tags, F.lit(1))
    traditional = F.arrays_overlap(tags, F.array(*[F.lit(x) for x in ("hant", "tw", "hk", "mo")]))
    return (
        F.when(primary == "ja", F.lit("Jpan"))
        .when(primary == "ko", F.lit("Hang"))
        .when((primary == "zh") & traditional, F.lit("Hant"))
        .when(primary == "zh", F.lit("Hans"))
    )
