"""Theme fonts, installed families and font coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from galley.functions.fonts import compact_key, strict_key, trimmed_name
from galley.functions.props import attr, bag_attr
from galley.functions.text import casefold, theme_script
from galley.functions.units import hex_color


def theme_fonts(theme: DataFrame, languages: DataFrame) -> DataFrame:
    """Theme font keys of every package as a map.

    ``theme`` has ``kind, grp, script, value``; ``languages`` has ``pkg_id,
    lang`` from the settings. The East Asian face is that of the language's
    script, else the general one, else a Chinese one, else the Latin one.
    """
    faces = (
        theme.filter(F.col("kind") == "font")
        .groupBy("pkg_id", "grp", "script")
        .agg(F.max_by("value", "ord").alias("value"))
        .groupBy("pkg_id", "grp")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("script", F.coalesce("value", F.lit("")).alias("value")))
            ).alias("faces")
        )
        .join(languages, "pkg_id", "left")
    )
    face = lambda script: F.try_element_at("faces", script)
    filled = lambda c: F.when(c != "", c)
    latin = F.coalesce(face(F.lit("latin")), F.lit(""))
    east = F.coalesce(
        filled(face(theme_script(F.col("lang")))),
        filled(face(F.lit("ea"))),
        filled(face(F.lit("Hans"))),
        filled(face(F.lit("Hant"))),
        latin,
    )
    entry = lambda suffix, value: F.struct(
        F.concat("grp", F.lit(suffix)).alias("key"), value.alias("value")
    )
    entries = F.array(entry("HAnsi", latin), entry("Ascii", latin), entry("EastAsia", east))
    return (
        faces.select("pkg_id", F.inline(entries))
        .groupBy("pkg_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("theme_fonts"))
    )


def theme_colors(theme: DataFrame) -> DataFrame:
    """Valid theme colours of every package as a map."""
    valid = theme.filter(F.col("kind") == "color").withColumn("value", hex_color(F.col("value")))
    return (
        valid.filter("value IS NOT NULL")
        .groupBy("pkg_id", "script")
        .agg(F.max_by("value", "ord").alias("value"))
        .groupBy("pkg_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("script", "value"))).alias("theme_colors"))
    )


def fold_fonts(levels: Column, theme: Column) -> Column:
    """Latin and East Asian font after every cascade level, as a struct.

    ``levels`` is an array of rFonts attribute maps from the defaults to the
    leaf. A level that names a theme font sets that font, and its own explicit
    one when the theme has none.
    """
    filled = lambda c: F.when(c != "", c)

    def pick(level: Column, explicit: list[str], themed: list[str], older: Column) -> Column:
        given = F.coalesce(*[filled(attr(level, n)) for n in explicit[:-1]], attr(level, explicit[-1]))
        key = F.coalesce(*[filled(attr(level, n)) for n in themed[:-1]], attr(level, themed[-1]))
        from_theme = filled(F.try_element_at(theme, key))
        return F.when(key.isNotNull(), F.coalesce(from_theme, given)).otherwise(
            F.coalesce(given, older)
        )

    def step(acc: Column, level: Column) -> Column:
        return F.struct(
            pick(level, ["ascii", "hAnsi"], ["asciiTheme", "hAnsiTheme"], acc["latin"]).alias("latin"),
            pick(level, ["eastAsia"], ["eastAsiaTheme"], acc["east"]).alias("east"),
        )

    none = F.lit(None).cast("string")
    return F.aggregate(levels, F.struct(none.alias("latin"), none.alias("east")), step)


def style_fonts(styles: DataFrame, resolved: DataFrame, theme_maps: DataFrame) -> DataFrame:
    """Effective fonts of every style.

    ``theme_maps`` comes from :func:`theme_fonts`.
    """
    fonts = F.try_element_at("rpr", F.lit("rFonts"))
    own = (
        styles.filter(fonts.isNotNull())
        .groupBy("pkg_id", F.coalesce("style_id", F.lit("")).alias("style_id"))
        .agg(F.max_by(fonts, "ord").alias("fonts"))
        .groupBy("pkg_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("style_id", "fonts"))).alias("own_fonts"))
    )
    path = F.concat(F.array(F.lit("")), F.reverse("chain"))
    levels = F.filter(
        F.transform(path, lambda s: F.try_element_at("own_fonts", s)), lambda x: x.isNotNull()
    )
    return (
        resolved.select("pkg_id", "style_id", "chain")
        .join(own, "pkg_id", "left")
        .join(theme_maps, "pkg_id", "left")
        .withColumn("f", fold_fonts(levels, F.col("theme_fonts")))
        .select(
            "pkg_id",
            "style_id",
            F.col("f.latin").alias("font_latin"),
            F.col("f.east").alias("font_east_asia"),
        )
    )


def text_color(rpr: Column, colors: Column) -> Column:
    """Explicit colour, else the theme colour a style names."""
    named = F.try_element_at(colors, bag_attr(rpr, "color", "themeColor"))
    return F.coalesce(hex_color(bag_attr(rpr, "color", "val")), named)


def font_families(faces: DataFrame) -> DataFrame:
    """Installed faces as families.

    ``faces`` has ``family, localized, postscript, weight, styled``. The
    preferred face is an upright one of weight nearest to 5, then by name.
    """
    named = (
        faces.withColumn("family", trimmed_name(F.col("family")))
        .withColumn("postscript", trimmed_name(F.col("postscript")))
        .withColumn("localized", trimmed_name(F.col("localized")))
        .filter("family IS NOT NULL AND postscript IS NOT NULL")
        .withColumn("family_key", strict_key(F.col("family")))
    )
    by_name = lambda c: F.struct(casefold(F.col(c)), F.col(c))
    rank = F.struct("styled", F.abs(F.col("weight") - 5), *[casefold(F.col("postscript")), "postscript"])
    return named.groupBy("family_key").agg(
        F.min_by("family", by_name("family")).alias("family"),
        F.min_by("postscript", rank).alias("preferred"),
        F.count(F.lit(1)).alias("faces"),
    )


def installed_keys(faces: DataFrame) -> DataFrame:
    """Every searchable name of a family, with its strict and compact key.

    One row per family and name; nothing is collected per family.
    """
    base = faces.withColumn("family_key", strict_key(trimmed_name(F.col("family"))))
    names = F.array("family", "localized", "postscript")
    spelled = (
        base.select("family_key", F.explode(names).alias("name"))
        .withColumn("name", trimmed_name(F.col("name")))
        .filter("name IS NOT NULL AND family_key IS NOT NULL")
        .distinct()
    )
    return spelled.select(
        "family_key",
        "name",
        strict_key(F.col("name")).alias("strict"),
        compact_key(F.col("name")).alias("compact"),
    )


def match_fonts(requests: DataFrame, aliases: DataFrame, faces: DataFrame) -> DataFrame:
    """Whether requested fonts are installed.

    ``requests`` has ``req_id, name``; ``aliases`` ``req_id, alias``. A name is
    looked up by strict key, then by compact key; its aliases count only when
    the name itself finds nothing. Candidates are counted, never listed.
    """
    keys = installed_keys(faces)
    exact = keys.groupBy("strict").agg(
        F.min("family_key").alias("s_low"), F.max("family_key").alias("s_high")
    )
    loose = keys.filter("compact <> ''").groupBy("compact").agg(
        F.min("family_key").alias("c_low"), F.max("family_key").alias("c_high")
    )

    def look(rows: DataFrame, name: str) -> DataFrame:
        return (
            rows.withColumn("strict", strict_key(F.col(name)))
            .withColumn("compact", compact_key(F.col(name)))
            .join(exact, "strict", "left")
            .join(loose, "compact", "left")
            .withColumn("low", F.coalesce("s_low", "c_low"))
            .withColumn("high", F.when(F.col("s_low").isNotNull(), F.col("s_high")).otherwise(F.col("c_high")))
            .drop("s_low", "s_high", "c_low", "c_high", "compact")
        )

    named = look(requests.withColumn("clean", trimmed_name(F.col("name"))), "clean")
    other = (
        look(aliases.withColumn("clean", trimmed_name(F.col("alias"))).filter("clean IS NOT NULL"), "clean")
        .filter("low IS NOT NULL")
        .groupBy("req_id")
        .agg(F.min("low").alias("a_low"), F.max("high").alias("a_high"))
    )
    registered = (
        faces.select(
            strict_key(trimmed_name(F.col("family"))).alias("family_key"),
            F.explode(F.array("family", "postscript")).alias("n"),
        )
        .select("family_key", strict_key(trimmed_name(F.col("n"))).alias("strict"))
        .distinct()
        .withColumn("registered", F.lit(True))
    )
    low = F.coalesce("low", "a_low")
    high = F.when(F.col("low").isNotNull(), F.col("high")).otherwise(F.col("a_high"))
    joined = (
        named.join(other, "req_id", "left")
        .withColumn("family_key", F.when(low == high, low))
        .withColumn("found", low.isNotNull())
        .join(registered, ["family_key", "strict"], "left")
    )
    kind = (
        F.when(F.col("clean").isNull(), F.lit("inherited"))
        .when(~F.col("found"), F.lit("missing"))
        .when(F.col("family_key").isNull(), F.lit("ambiguous"))
        .when(F.col("registered"), F.lit("installed"))
        .otherwise(F.lit("alias"))
    )
    return joined.select("req_id", "name", kind.alias("kind"), "family_key")


def name_postings(faces: DataFrame) -> DataFrame:
    """``suffix, family_key``: every ending of every installed name, in order of suffix, to be stored and searched.

    A name is short, so there are a few rows per name; endings that names of a family share are one row.
    """
    names = installed_keys(faces).filter("compact <> ''").select("family_key", "compact").distinct()
    size = F.length("compact")
    endings = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring("compact", i, size))
    rows = names.select(F.explode(endings).alias("suffix"), "family_key").distinct()
    return rows.repartitionByRange("suffix", "family_key").sortWithinPartitions("suffix")


def search_postings(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, family_key`` of the families with a name whose compact key contains the query's.

    ``queries`` has ``query_id, query``. A name contains what one of its endings begins with. Each ending is cut once per length that
    is asked for and meets at most one text of that length, so the work grows with the names, however many queries ask for one text
    or share a part of it. A query without any letter or digit finds nothing here, since it asks for the list of all families.
    """
    keyed = queries.withColumn("wanted", compact_key(F.col("query"))).filter("wanted <> ''").select("query_id", "wanted").distinct()
    asked = keyed.select("wanted").distinct()
    sizes = asked.agg(F.collect_set(F.length("wanted")).alias("sizes"))
    cut = F.transform(F.filter("sizes", lambda n: n <= F.length("suffix")), lambda n: F.substring("suffix", F.lit(1), n))
    heads = postings.crossJoin(F.broadcast(sizes)).select("family_key", F.explode(cut).alias("wanted"))
    met = heads.join(asked, "wanted").distinct()
    return keyed.join(met, "wanted").select("query_id", "family_key").distinct()


def search_families(faces: DataFrame, query: str) -> DataFrame:
    """Families with a name whose compact key contains the query's."""
    wanted = compact_key(F.lit(query))
    keys = installed_keys(faces)
    return keys.filter((wanted == "") | F.contains("compact", wanted)).select("family_key").distinct()


def font_options(formats: DataFrame) -> DataFrame:
    """Fonts offered per role, spellings merged.

    ``formats`` has ``role, ord, font, aliases``.
    """
    named = formats.withColumn("font", trimmed_name(F.col("font"))).filter("font IS NOT NULL")
    keyed = named.withColumn("key", strict_key(F.col("font")))
    names = keyed.groupBy("role", "key").agg(F.min_by("font", "ord").alias("font"))
    others = (
        keyed.select("role", "key", F.explode("aliases").alias("alias"))
        .withColumn("alias", trimmed_name(F.col("alias")))
        .filter("alias IS NOT NULL")
        .filter(strict_key(F.col("alias")) != F.col("key"))
        .distinct()
        .groupBy("role", "key")
        .agg(F.count(F.lit(1)).alias("alias_count"), F.min("alias").alias("first_alias"))
    )
    return names.join(others, ["role", "key"], "left").fillna(0, ["alias_count"])


def missing_font_records(edits: DataFrame, font_table: DataFrame) -> DataFrame:
    """Fonts used in edits that the font table does not list yet."""
    wanted = (
        edits.filter(F.col("field").isin("font_latin", "font_east_asia"))
        .groupBy("pack_id", casefold(F.col("value")).alias("key"))
        .agg(F.min("value").alias("name"))
    )
    known = font_table.select("pack_id", casefold(F.col("name")).alias("key"))
    return wanted.join(known, ["pack_id", "key"], "left_anti")
