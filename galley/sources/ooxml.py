"""XML parts to rows: content, styles, numbering, relationships, theme, fonts.

Parsing XML is the one step Spark expressions cannot do, so each reader is a
small generator run by ``mapInArrow`` over the member rows of one role. A part
is at most 64 MiB, and rows leave in bounded batches.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from galley import schemas as S
from galley.functions.paths import is_content_part, rel_role, resolve_target, story
from galley.functions.props import bag_attr
from galley.functions.units import lenient_int
from galley.registries import FORMAT_ROLES, OFFICE_REL, ROLE_DEFAULT_PART, SECTION_TAGS

_BATCH = 4096
# Children of a paragraph that leave its text plain.
_HARMLESS = {
    "pPr", "bookmarkStart", "bookmarkEnd", "commentRangeStart", "commentRangeEnd", "proofErr",
    "permStart", "permEnd",
}
_REVISIONS = {"ins", "del", "pPrChange", "rPrChange"}


def _local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def _child(node: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        if node is None:
            return None
        node = next((c for c in node if _local(c) == name), None)
    return node


def _get(node: ET.Element | None, name: str = "val") -> str | None:
    if node is None:
        return None
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _attrs(node: ET.Element) -> list[tuple[str, str]]:
    return [(k.rsplit("}", 1)[-1], v) for k, v in node.attrib.items()]


def _int(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def _bag(node: ET.Element | None) -> list[tuple[str, list[tuple[str, str]]]] | None:
    """Properties of a container; nested settings become dotted attributes."""
    if node is None:
        return None
    bag: dict[str, list[tuple[str, str]]] = {}
    for prop in node:
        values = dict(_attrs(prop))
        for inner in prop:
            for key, value in _attrs(inner):
                plain = _local(prop) == "numPr" and key == "val"
                values.setdefault(_local(inner) if plain else f"{_local(inner)}.{key}", value)
        bag[_local(prop)] = list(values.items())
    return list(bag.items())


def _text(run: ET.Element) -> str:
    return "".join(
        (x.text or "") if _local(x) == "t" else "\t" for x in run if _local(x) in ("t", "tab")
    )


#: Containers of a row, with the child that holds their properties and the property that names their style.
_OWNERS = {
    "p": ("paragraph", "pPr", "pStyle"),
    "r": ("run", "rPr", "rStyle"),
    "tbl": ("table", "tblPr", "tblStyle"),
}
#: Property containers that are rows by themselves.
_BARE = {"trPr": "row", "tcPr": "cell", "sectPr": "section"}
_PROPERTIES = {"pPr", "rPr", "tblPr", *_BARE}
_FEED = 1 << 16


@dataclass
class _Open:
    """An element whose end has not been read: where it stands, and what its children have told so far."""

    node: ET.Element
    name: str
    in_cell: bool
    para: int | None
    table: int | None
    ord: int = -1
    plain: bool = True
    texts: list[str] = field(default_factory=list)


def _content_rows(data: bytes) -> Iterator[dict]:
    """Nodes of a content part; the order is counted per kind, from where elements begin.

    The part is read piece by piece. An element is let go as soon as it ends, but for properties, which stay until their owner
    ends, so memory follows the largest paragraph and not the part.
    """
    counts = dict.fromkeys(("paragraph", "run", "table", "row", "cell", "section", "revision"), -1)
    parser = ET.XMLPullParser(("start", "end"))
    stack: list[_Open] = []
    held = 0  # open property containers
    for lo in range(0, len(data), _FEED):
        parser.feed(data[lo : lo + _FEED])
        for event, node in parser.read_events():
            if event == "start":
                name = _local(node)
                up = stack[-1] if stack else _Open(node, "", False, None, None)
                # What is inside a paragraph or a table belongs to it; the element itself to what is around it.
                para = up.ord if up.name == "p" else up.para
                table = up.ord if up.name == "tbl" else up.table
                here = _Open(node, name, up.in_cell or up.name == "tc", para, table)
                kind = _OWNERS[name][0] if name in _OWNERS else _BARE.get(name)
                if kind:
                    counts[kind] += 1
                    here.ord = counts[kind]
                elif name in _REVISIONS:
                    counts["revision"] += 1
                    yield {"kind": "revision", "ord": counts["revision"], "revised": True}
                held += name in _PROPERTIES
                stack.append(here)
                continue
            here = stack.pop()
            name, up = here.name, stack[-1] if stack else None
            held -= name in _PROPERTIES
            if name in _OWNERS:
                kind, holder, style = _OWNERS[name]
                props = _child(node, holder)
                row = {
                    "kind": kind,
                    "ord": here.ord,
                    "parent_ord": {"paragraph": None, "run": here.para, "table": here.table}[kind],
                    "style_id": _get(_child(props, style)),
                    "has_bag": props is not None,
                    "bag": _bag(props),
                    "in_table": here.in_cell,
                }
                if kind == "paragraph":
                    row |= {"plain": here.plain, "text": "".join(here.texts)}
                elif kind == "run":
                    row["text"] = _text(node)
                yield row
            elif name in _BARE:
                yield {"kind": _BARE[name], "ord": here.ord, "parent_ord": here.table, "has_bag": True, "bag": _bag(node)}
            if up is None:
                continue
            if up.name == "p":
                if name == "r":
                    up.texts.append(row["text"])
                    up.plain = up.plain and here.plain
                else:
                    up.plain = up.plain and name in _HARMLESS
            elif up.name == "r":
                up.plain = up.plain and name in ("rPr", "t", "tab")
            if not held and name not in _PROPERTIES and up.name != "r":
                up.node.remove(node)
    parser.close()


def _style_rows(root: ET.Element) -> Iterator[dict]:
    defaults = _child(root, "docDefaults")
    if defaults is not None:
        yield {
            "ord": -1,
            "ppr": _bag(_child(defaults, "pPrDefault", "pPr")),
            "rpr": _bag(_child(defaults, "rPrDefault", "rPr")),
        }
    for ord_, node in enumerate(n for n in root if _local(n) == "style"):
        style_id = _get(node, "styleId")
        if not style_id:
            continue
        level = _int(_get(_child(node, "pPr", "outlineLvl")))
        aliases = (_get(_child(node, "aliases")) or "").split(",")
        yield {
            "ord": ord_,
            "style_id": style_id,
            "style_type": _get(node, "type") or "paragraph",
            "name": _get(_child(node, "name")) or style_id,
            "aliases": [a.strip() for a in aliases if a.strip()],
            "based_on": _get(_child(node, "basedOn")),
            "own_outline": level if level is not None and 0 <= level <= 9 else None,
            "is_default": _get(node, "default") in ("1", "true", "on"),
            "ppr": _bag(_child(node, "pPr")),
            "rpr": _bag(_child(node, "rPr")),
            "tpr": _bag(_child(node, "tblPr")),
        }


def _level_values(node: ET.Element | None) -> dict:
    ppr = _child(node, "pPr")
    ind, fonts = _child(ppr, "ind"), _child(node, "rPr", "rFonts")
    return {
        "start": _int(_get(_child(node, "start"))),
        "num_fmt": _get(_child(node, "numFmt")),
        "lvl_text": _get(_child(node, "lvlText")),
        "lvl_restart": _int(_get(_child(node, "lvlRestart"))),
        "pstyle": _get(_child(node, "pStyle")),
        "ind": _attrs(ind) if ind is not None else None,
        "fonts": _attrs(fonts) if fonts is not None else None,
        "tab_pos": _int(_get(_child(ppr, "tabs", "tab"), "pos")),
    }


def _numbering_rows(root: ET.Element) -> Iterator[dict]:
    for ord_, node in enumerate(root):
        if _local(node) == "abstractNum":
            owner = {"abstract_id": _get(node, "abstractNumId"), "ord": ord_}
            yield owner | {
                "kind": "abstract",
                "num_style_link": _get(_child(node, "numStyleLink")),
                "nsid": _get(_child(node, "nsid")),
            }
            for pos, lvl in enumerate(c for c in node if _local(c) == "lvl"):
                yield owner | _level_values(lvl) | {
                    "kind": "level", "ord": pos, "ilvl": _int(_get(lvl, "ilvl")),
                }
        elif _local(node) == "num":
            owner = {"num_id": _get(node, "numId"), "ord": ord_}
            yield owner | {"kind": "num", "abstract_id": _get(_child(node, "abstractNumId"))}
            for pos, over in enumerate(c for c in node if _local(c) == "lvlOverride"):
                lvl = _child(over, "lvl")
                yield owner | (_level_values(lvl) if lvl is not None else {}) | {
                    "kind": "override",
                    "ord": pos,
                    "ilvl": _int(_get(over, "ilvl")),
                    "start_override": _int(_get(_child(over, "startOverride"))),
                    "has_lvl": lvl is not None,
                }


def _rel_rows(root: ET.Element) -> Iterator[dict]:
    for ord_, node in enumerate(n for n in root if _local(n) == "Relationship"):
        yield {
            "ord": ord_,
            "rel_id": node.get("Id"),
            "rel_type": node.get("Type"),
            "target": node.get("Target"),
            "target_mode": node.get("TargetMode"),
        }


def _theme_rows(root: ET.Element) -> Iterator[dict]:
    elements = _child(root, "themeElements")
    for grp in ("major", "minor"):
        group = _child(elements, "fontScheme", grp + "Font")
        for ord_, node in enumerate(group if group is not None else ()):
            script = {"latin": "latin", "ea": "ea", "font": node.get("script")}.get(_local(node))
            if script:
                yield {
                    "kind": "font", "ord": ord_, "grp": grp, "script": script,
                    "value": node.get("typeface"),
                }
    scheme = _child(elements, "clrScheme")
    for ord_, node in enumerate(scheme if scheme is not None else ()):
        rgb, system = _child(node, "srgbClr"), _child(node, "sysClr")
        value = rgb.get("val") if rgb is not None else None
        if rgb is None and system is not None:
            value = system.get("lastClr")
        yield {"kind": "color", "ord": ord_, "script": _local(node), "value": value}


def _font_rows(root: ET.Element) -> Iterator[dict]:
    for ord_, node in enumerate(n for n in root if _local(n) == "font"):
        yield {"ord": ord_, "name": _get(node, "name"), "alt_name": _get(_child(node, "altName"))}


def _settings_rows(root: ET.Element) -> Iterator[dict]:
    for ord_, node in enumerate(root):
        yield {"ord": ord_, "tag": _local(node), "attrs": _attrs(node)}


def readable_xml(data: bytes) -> bool:
    """Whether a part is well formed; nothing of it is kept."""
    try:
        expat.ParserCreate().Parse(data, True)
    except expat.ExpatError:
        return False
    return True


def _parse(parts: DataFrame, rows: Callable, ddl: str, extra: Callable | None = None, streamed: bool = False) -> DataFrame:
    """Run a row generator over member contents, as a tree or, ``streamed``, as the bytes of a well-formed part.

    Files with unreadable XML are rejected by the scan; here such a part gives no rows.
    """
    key_type = dict(parts.dtypes)["pkg_id"]
    out_ddl = f"pkg_id {key_type}, {ddl}"
    schema = to_arrow_schema(StructType.fromDDL(out_ddl))

    def every(batch: pa.RecordBatch) -> Iterator[dict]:
        for pkg_id, name, data in zip(
            batch["pkg_id"].to_pylist(), batch["name"].to_pylist(), batch["content"]
        ):
            raw = data.as_py()
            try:
                root = raw if streamed and readable_xml(raw) else ET.fromstring(raw)
            except ET.ParseError:
                continue
            fixed = {"pkg_id": pkg_id} | (extra(name) if extra else {})
            for row in rows(root):
                yield row | fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pending = every(batch)
            while chunk := list(islice(pending, _BATCH)):
                yield pa.RecordBatch.from_pylist(chunk, schema=schema)

    return parts.select("pkg_id", "name", "content").mapInArrow(run, out_ddl)


def content(parts: DataFrame) -> DataFrame:
    """Paragraphs, runs, tables, rows, cells and sections of content parts."""
    chosen = parts.filter(is_content_part(F.col("name")))
    return _parse(chosen, _content_rows, S.NODES, lambda name: {"part": name}, streamed=True)


def relationships(parts: DataFrame) -> DataFrame:
    """Relationship rows with the part they start from."""

    def base(name: str) -> dict:
        folder, _, leaf = name.rpartition("_rels/")
        return {"base_part": folder + leaf.removesuffix(".rels")}

    chosen = parts.filter(F.col("name").rlike(r"(^|/)_rels/[^/]+\.rels$"))
    return _parse(chosen, _rel_rows, S.RELS, base)


def format_roles(rels: DataFrame) -> DataFrame:
    """Part that plays each format role; the last internal relationship wins."""
    mine = rels.filter(
        (F.col("base_part") == "word/document.xml")
        & (F.coalesce("target_mode", F.lit("Internal")) != "External")
        & (F.coalesce("target", F.lit("")) != "")
    ).withColumn("role", rel_role(F.col("rel_type")))
    part = resolve_target(F.col("base_part"), F.col("target"))
    return (
        mine.filter(F.col("role").isin(*FORMAT_ROLES))
        .groupBy("pkg_id", "role")
        .agg(F.max_by(F.struct(part.alias("part"), "rel_id"), "ord").alias("last"))
        .select("pkg_id", "role", "last.part", "last.rel_id")
    )


def role_members(parts: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """Member that plays a role, or the role's usual part."""
    mine = roles.filter(F.col("role") == role).select("pkg_id", "part")
    usual = F.lit(ROLE_DEFAULT_PART[role])
    xml = parts.filter(F.col("name").endswith(".xml"))
    return (
        xml.join(mine, "pkg_id", "left")
        .filter(F.col("name") == F.coalesce("part", usual))
        .drop("part")
    )


def styles(parts: DataFrame) -> DataFrame:
    """Style rows in document order; ``ord`` -1 holds the document defaults."""
    return _parse(parts, _style_rows, S.STYLES)


def numbering_rows(parts: DataFrame) -> DataFrame:
    """Rows of numbering parts, of all kinds."""
    return _parse(parts, _numbering_rows, S.NUMBERING)


def numbering(parts: DataFrame) -> dict[str, DataFrame]:
    """Abstract lists, concrete lists, levels and overrides."""
    return numbering_tables(numbering_rows(parts))


def numbering_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of :func:`numbering` from the rows of :func:`numbering_rows`."""
    level = ["start", "num_fmt", "lvl_text", "lvl_restart"]
    shape = {
        "abstract": ["abstract_id", "ord", "num_style_link", "nsid"],
        "num": ["num_id", "abstract_id", "ord"],
        "level": ["abstract_id", "ilvl", "ord", *level, "pstyle", "fonts", "ind", "tab_pos"],
        "override": ["num_id", "ilvl", "ord", "start_override", "has_lvl", *level],
    }
    return {
        kind: rows.filter(F.col("kind") == kind).select("pkg_id", *cols)
        for kind, cols in shape.items()
    }


def theme(parts: DataFrame) -> DataFrame:
    return _parse(parts, _theme_rows, S.THEME)


def font_table(parts: DataFrame) -> DataFrame:
    return _parse(parts, _font_rows, S.FONTS)


def settings(parts: DataFrame) -> DataFrame:
    return _parse(parts.filter(F.col("name") == "word/settings.xml"), _settings_rows, S.SETTINGS)


def paragraphs(nodes: DataFrame) -> DataFrame:
    """Paragraph rows with their direct outline and list reference."""
    level = lenient_int(bag_attr(F.col("bag"), "outlineLvl", "val"))
    return nodes.filter(F.col("kind") == "paragraph").select(
        "pkg_id",
        "part",
        story(F.col("part")).alias("story"),
        "ord",
        "style_id",
        F.col("has_bag").alias("has_ppr"),
        F.when(level.between(0, 9), level.cast("int")).alias("direct_outline"),
        bag_attr(F.col("bag"), "numPr", "numId").alias("num_id"),
        lenient_int(bag_attr(F.col("bag"), "numPr", "ilvl")).cast("int").alias("ilvl"),
        F.col("bag").alias("ppr"),
        "in_table",
        "plain",
        "text",
    )


def sections(nodes: DataFrame) -> DataFrame:
    """Layout tags of every section, in order, restricted to the allow-list."""
    return (
        nodes.filter(F.col("kind") == "section")
        .select("pkg_id", "part", F.col("ord").cast("int").alias("idx"), F.explode_outer("bag"))
        .filter(F.col("key").isin(*SECTION_TAGS))
        .select("pkg_id", "part", "idx", F.col("key").alias("tag"), F.col("value").alias("attrs"))
    )


def frame_references(parts: DataFrame) -> DataFrame:
    """Relationship ids of the headers and footers that sections of the body refer to."""
    link = "{" + OFFICE_REL + "}id"

    def rows(root: ET.Element) -> Iterator[dict]:
        for node in root.iter():
            if _local(node) in ("headerReference", "footerReference") and node.get(link):
                yield {"rel_id": node.get(link)}

    return _parse(parts.filter(F.col("name") == "word/document.xml"), rows, "rel_id string").distinct()
