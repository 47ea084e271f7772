"""Document packages made from the driver tables: XML parts and ZIP bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from xml.sax.saxutils import quoteattr

from harness import adapters as A, templates as T

_BATCH_BYTES = 4 * 1024 * 1024
_BATCH_ROWS = 256
_SUBFOLDERS = 256

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _tag(name: str, attrs: dict, inner: str = "") -> str:
    pairs = "".join(f" w:{k}={quoteattr(str(v))}" for k, v in attrs.items() if v is not None)
    return f"<w:{name}{pairs}>{inner}</w:{name}>"


def _bag(name: str, bag: dict) -> str:
    def prop(p: str, attrs: dict) -> str:
        if p == "numPr":
            return _tag(p, {}, "".join(_tag(k, {"val": v}) for k, v in attrs.items()))
        return _tag(p, attrs)

    return _tag(name, {}, "".join(prop(p, a) for p, a in bag.items())) if bag else ""


def styles_xml(lang: str) -> str:
    ppr, rpr = T.DOC_DEFAULTS
    out = _tag(
        "docDefaults", {}, _tag("rPrDefault", {}, _bag("rPr", rpr)) + _tag("pPrDefault", {}, _bag("pPr", ppr))
    )
    for sid, kind, name, aliases, based, level, default, ppr, rpr in T.TARGET_SHEETS[lang]:
        if level is not None:
            ppr = ppr | {"outlineLvl": {"val": level}}
        inner = _tag("name", {"val": name})
        if aliases:
            inner += _tag("aliases", {"val": ", ".join(aliases)})
        if based:
            inner += _tag("basedOn", {"val": based})
        out += _tag(
            "style", {"type": kind, "styleId": sid, "default": "1" if default else None},
            inner + _bag("pPr", ppr) + _bag("rPr", rpr),
        )
    return f"<w:styles {W}>{out}</w:styles>"


def numbering_xml() -> str:
    val = lambda tag, v: "" if v is None else _tag(tag, {"val": v})
    out = ""
    for aid, link, nsid in T.ABSTRACTS:
        inner = val("nsid", nsid) + val("numStyleLink", link)
        for a, ilvl, start, fmt, text, restart, pstyle, left, hanging, tab in T.LEVELS:
            if a == aid:
                tabs = _tag("tabs", {}, _tag("tab", {"pos": tab})) if tab is not None else ""
                ppr = _tag("pPr", {}, tabs + _tag("ind", {"left": left, "hanging": hanging}))
                body = val("start", start) + val("numFmt", fmt) + val("lvlRestart", restart) + val("pStyle", pstyle) + val("lvlText", text)
                inner += _tag("lvl", {"ilvl": ilvl}, body + ppr)
        out += _tag("abstractNum", {"abstractNumId": aid}, inner)
    for num, aid in T.NUMS:
        inner = val("abstractNumId", aid)
        for n, ilvl, so, has, start, fmt, text, restart in T.OVERRIDES:
            if n == num:
                lvl = _tag("lvl", {"ilvl": ilvl}, val("start", start) + val("numFmt", fmt) + val("lvlText", text)) if has else ""
                inner += _tag("lvlOverride", {"ilvl": ilvl}, val("startOverride", so) + lvl)
        out += _tag("num", {"numId": num}, inner)
    return f"<w:numbering {W}>{out}</w:numbering>"


RELS_XML = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
    '<Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/numbering" Target="lists/old.xml"/>'
    '<Relationship Id="r3" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/numbering" Target="/word/numbering.xml"/>'
    '<Relationship Id="r4" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink" Target="http://x" TargetMode="External"/>'
    "</Relationships>"
)
TYPES_XML = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'


def _paragraph_xml():
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    piece = lambda col, fmt: F.when(F.col(col).isNotNull(), F.format_string(fmt, F.col(col).cast("string"))).otherwise(F.lit(""))
    wrap = lambda cols, tag, inner: F.when(F.coalesce(*[F.col(c) for c in cols]).isNotNull(), F.concat(F.lit(f"<w:{tag}"), inner, F.lit("/>"))).otherwise(F.lit(""))
    numbered = F.when(
        F.coalesce("num_id", "ilvl_raw").isNotNull(),
        F.concat(F.lit("<w:numPr>"), piece("ilvl_raw", '<w:ilvl w:val="%s"/>'), piece("num_id", '<w:numId w:val="%s"/>'), F.lit("</w:numPr>")),
    ).otherwise(F.lit(""))
    ppr = F.concat(
        piece("style_id", '<w:pStyle w:val="%s"/>'), numbered, piece("sp_before", '<w:spacing w:before="%s"/>'),
        wrap(["ind_left", "ind_chars"], "ind", F.concat(piece("ind_left", ' w:left="%s"'), piece("ind_chars", ' w:firstLineChars="%s"'))),
        piece("jc", '<w:jc w:val="%s"/>'), piece("direct_outline", '<w:outlineLvl w:val="%s"/>'),
    )
    body = F.concat(
        F.lit("<w:p>"), F.when(ppr != "", F.concat(F.lit("<w:pPr>"), ppr, F.lit("</w:pPr>"))).otherwise(F.lit("")),
        F.when(F.col("plain"), F.lit("")).otherwise(F.lit("<w:hyperlink/>")),
        F.lit("<w:r><w:t>"), esc(F.col("text")), F.lit("</w:t></w:r></w:p>"),
    )
    return F.when(F.col("in_table"), F.concat(F.lit("<w:tbl><w:tr><w:tc>"), body, F.lit("</w:tc></w:tr></w:tbl>"))).otherwise(body)


def document_parts(spark: SparkSession, d: str) -> DataFrame:
    """The document part of every package, built from its lines."""
    xml = A.par(spark, d).select("pkg_id", "ord", _paragraph_xml().alias("xml"))
    joined = xml.groupBy("pkg_id").agg(F.array_sort(F.collect_list(F.struct("ord", "xml"))).alias("p"))
    sect = '<w:sectPr><w:headerReference w:id="x"/><w:pgSz w:w="11906" w:h="16838"/></w:sectPr>'
    body = F.concat(F.lit(f"<w:document {W}><w:body>"), F.array_join(F.transform("p", lambda x: x["xml"]), ""), F.lit(f"{sect}</w:body></w:document>"))
    return joined.select("pkg_id", F.lit("word/document.xml").alias("name"), F.encode(body, "UTF-8").alias("content"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """All parts of every package."""
    docs = A.docs(spark, d).select("pkg_id", "lang")
    style = F.element_at(F.create_map(*[x for k in T.TARGET_SHEETS for x in (F.lit(k), F.lit(styles_xml(k)))]), F.col("lang"))
    part = lambda name, text: F.struct(F.lit(name).alias("name"), F.encode(text, "UTF-8").alias("content"))
    fixed = F.array(
        part("word/styles.xml", style), part("word/numbering.xml", F.lit(numbering_xml())),
        part("word/_rels/document.xml.rels", F.lit(RELS_XML)), part("[Content_Types].xml", F.lit(TYPES_XML)),
    )
    return docs.select("pkg_id", F.inline(fixed)).unionByName(document_parts(spark, d))


def archives(spark: SparkSession, d: str) -> DataFrame:
    """Packages as files: ``path, length, content``. A package's parts are
    bounded by its document; some files are cut short to be unreadable."""
    ddl = "path string, length bigint, content binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def packed(pkg_id: int, parts: list[dict]) -> dict:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
            for part in parts:
                if not (pkg_id % 13 == 5 and part["name"] == "word/styles.xml"):
                    cut = pkg_id % 19 == 4 and part["name"] == "word/document.xml"
                    out.writestr(part["name"], part["content"][:-9] if cut else part["content"])
        if pkg_id % 17 == 2:
            buffer = io.BytesIO()
            zipfile.ZipFile(buffer, "w").close()
        data = buffer.getvalue()
        data = data[: len(data) // 2] if pkg_id % 10 == 3 else data
        return {"path": f"{pkg_id}.docx", "length": len(data), "content": data}

    return _grouped(spark, d).mapInArrow(lambda batches: packed_batches(batches, packed, schema), ddl)


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).groupBy("pkg_id").agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("parts"))


def packed_batches(batches: Iterator[pa.RecordBatch], packed, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Files of packages one after the other; a batch of rows that comes in is never held as Python objects."""
    rows, held = [], 0
    for batch in batches:
        for pkg_id, parts in zip(batch["pkg_id"], batch["parts"]):
            rows.append(packed(pkg_id.as_py(), parts.as_py()))
            held += rows[-1]["length"]
            if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def files(spark: SparkSession, d: str, folder: str) -> str:
    """The packages as files below a folder that all executors share; returns the folder. They are dealt to subfolders, so that
    none holds more than its share, however many packages there are."""
    import os
    import zlib

    target = folder.removeprefix("file:")
    os.makedirs(target, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                place = f"{target}/{zlib.crc32(path.encode()) % _SUBFOLDERS:02x}"
                os.makedirs(place, exist_ok=True)
                with open(f"{place}/{path}", "wb") as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([batch["path"]], names=["path"])

    archives(spark, d).mapInArrow(write, "path string").count()
    return folder
