"""Style sheets and numbering that documents and packs are given.

The driver tables have texts but no style sheets, so every document gets that
of its language, and packs are four fixed format sources. The texts below are
rendered as VALUES for both engines from one definition.
"""

from __future__ import annotations

# (style_id, type, name, aliases, based_on, outline, default, ppr, rpr)
_HEADING_NAMES = {
    "en": "heading {}", "de": "Überschrift {}", "fr": "Titre {}", "es": "Título {}",
}


def _sheet(lang: str) -> list[tuple]:
    h = _HEADING_NAMES[lang].format
    flag = lang != "fr"
    body_font = {"en": "Calibri", "de": "Arial", "fr": "Garamond", "es": "Georgia"}[lang]
    return [
        ("Normal", "paragraph", "Standard" if lang == "de" else "Normal", [], None, None, flag,
         {"spacing": {"after": "160", "line": "259", "lineRule": "auto"}},
         {"rFonts": {"ascii": body_font, "eastAsiaTheme": "minorEastAsia"}, "sz": {"val": "20"}}),
        ("Body", "paragraph", "Body Text", ["body", "Fließtext"], "Normal", None, False,
         {"ind": {"firstLineChars": "200", "firstLine": "420"}, "jc": {"val": "both"}}, {}),
        ("Head", "paragraph", "Heading Base", [], "Normal", None, False,
         {"keepNext": {}, "spacing": {"before": "240"}},
         {"b": {}, "rFonts": {"asciiTheme": "majorHAnsi"}}),
        ("H1", "paragraph", h(1), ["Title One"], "Head", 0, False,
         {"spacing": {"before": "360", "after": "120"}, "numPr": {"numId": "1", "ilvl": "0"},
          "outlineLvl": {"val": "0"}},
         {"sz": {"val": "42"}, "color": {"val": "1F3864"}}),
        ("H2", "paragraph", h(2), [], "Head", 1, False,
         {"ind": {"left": "360", "hanging": "360"}, "spacing": {"before": "280", "after": "80"},
          "numPr": {"numId": "1", "ilvl": "1"}, "outlineLvl": {"val": "1"}},
         {"sz": {"val": "36"}, "b": {"val": "off"}}),
        ("H3", "paragraph", h(3), ["Third"], "H2", 2, False,
         {"ind": {"firstLine": "0", "leftChars": "0"}, "spacing": {"before": "200"},
          "numPr": {"ilvl": "2"}},
         {"sz": {"val": "30"}, "color": {"themeColor": "accent1"}}),
        ("H4", "paragraph", h(4), [], "H3", 3, False,
         {"numPr": {"numId": "9", "ilvl": "3"}}, {"szCs": {"val": "24"}}),
        ("Cell", "paragraph", "Table Text", [], "Body", None, False,
         {"ind": {"hangingChars": "0", "end": "120"}}, {"sz": {"val": "18"}}),
        ("LoopA", "paragraph", "Loop A", [], "LoopB", None, False,
         {"jc": {"val": "left"}}, {"i": {"val": "1"}}),
        ("LoopB", "paragraph", "Loop B", [], "LoopA", 4 if lang == "es" else None, False,
         {"jc": {"val": "right"}, "ind": {"left": "90", "firstLine": "30"}}, {"i": {"val": "no"}}),
        ("Orphan", "paragraph", "Or-phan_ style", [], "Missing", 9, False,
         {"numPr": {"numId": "0"}}, {}),
        ("List", "paragraph", "List Para", [], "Body", None, False,
         {"numPr": {"numId": "2"}, "ind": {"hanging": "240"}}, {}),
        ("ListDeep", "paragraph", "List Deep", [], "List", None, False,
         {"numPr": {"ilvl": "3"}, "ind": {"firstLineChars": "100"}}, {}),
        ("Linked", "paragraph", "Linked Heading", [], "Head", 1, False, {}, {"sz": {"val": "28"}}),
        ("DefaultChar", "character", "Default Paragraph Font", [], None, None, lang == "en", {}, {}),
        ("Strong", "character", "Strong", ["Fett"], "DefaultChar", None, False, {},
         {"b": {"val": "true"}, "color": {"val": "#ff0000"}}),
        ("Quote", "character", "Quote Char", [], "Strong", None, False, {},
         {"i": {}, "rFonts": {"hAnsi": "Cambria"}}),
        ("PlainTable", "table", "Table Normal", [], None, None, lang in ("en", "es"), {}, {}),
        ("GridA", "table", "Grid Table", ["Raster"], "PlainTable", None, False, {}, {}),
        ("NumStyle", "numbering", "Num Style", [], None, None, False,
         {"numPr": {"numId": "2" if lang == "es" else "3"}}, {}),
    ]


TARGET_SHEETS = {lang: _sheet(lang) for lang in _HEADING_NAMES}

# (ppr, rpr) of the document defaults.
DOC_DEFAULTS = (
    {"spacing": {"before": "0", "afterAutospacing": "1"}, "jc": {"val": "start"}},
    {"rFonts": {"ascii": "Times", "hAnsi": "Times", "eastAsia": "SimSun"}, "lang": {"val": "en-US"}},
)

# (abstract_id, num_style_link, nsid)
ABSTRACTS = [("0", None, "0A0B0C0D"), ("1", None, "11111111"), ("2", "NumStyle", "22222222"), ("3", None, "33333333")]
# (num_id, abstract_id)
NUMS = [("1", "0"), ("2", "2"), ("3", "3"), ("4", "1"), ("5", "7")]
# (abstract_id, ilvl, start, num_fmt, lvl_text, lvl_restart, pstyle, left, hanging, tab)
LEVELS = [
    ("0", 0, 1, "decimal", "%1", None, "H1", 600, 600, 600),
    ("0", 1, 1, "decimal", "%1.%2", None, "H2", 960, 600, 960),
    ("0", 2, 1, "decimal", "%1.%2.%3", 0, "H3", 1320, 600, 1400),
    ("1", 0, 2, "lowerLetter", "(%1)", None, "Linked", 300, 300, None),
    ("1", 1, 1, "decimal", "%2)", 1, None, 500, 300, None),
    ("3", 0, 5, "upperRoman", "%1.", None, None, 400, 200, 400),
    ("3", 3, 1, "decimal", "%4-", None, None, 900, 200, None),
]
# (num_id, ilvl, start_override, has_lvl, start, num_fmt, lvl_text, lvl_restart)
OVERRIDES = [
    ("1", 0, 3, False, None, None, None, None),
    ("3", 0, None, True, 7, "lowerRoman", None, None),
    ("4", 1, None, True, 4, "none", "x", None),
    ("4", 2, 2, True, 4, "decimal", "%3", None),
]

# (pack_id, style_id, type, name, aliases, outline, default, two_chars)
PACK_STYLES = [
    ("atlas", "Normal", "paragraph", "Normal", [], None, True, True),
    ("atlas", "Heading1", "paragraph", "heading 1", [], 0, False, False),
    ("atlas", "Heading2", "paragraph", "heading 2", [], 1, False, False),
    ("atlas", "Heading3", "paragraph", "heading 3", [], 2, False, False),
    ("atlas", "BodyText", "paragraph", "Body-Text", ["Copy"], None, False, True),
    ("atlas", "CellText", "paragraph", "Table_Text", [], None, False, False),
    ("atlas", "Plain", "character", "Plain", [], None, True, False),
    ("atlas", "Bold", "character", "Strong", [], None, False, False),
    ("atlas", "TableNormal", "table", "Normal Table", [], None, True, False),
    ("atlas", "GridA", "table", "Grid A", [], None, False, False),
    ("birch", "Standard", "paragraph", "Standard", [], None, True, False),
    ("birch", "H1", "paragraph", "Kapitel", [], 0, False, False),
    ("birch", "H2", "paragraph", "Abschnitt", [], 1, False, False),
    ("birch", "H3", "paragraph", "Punkt", [], 2, False, False),
    ("birch", "Title3", "paragraph", "标题 3", [], 2, False, False),
    ("birch", "Body", "paragraph", "Text", [], None, False, True),
    ("birch", "Cell", "character", "Cell", [], None, False, False),
    ("birch", "Quote", "character", "Zitat", [], None, False, False),
    ("birch", "Tab", "table", "Raster", [], None, False, False),
    ("cedar", "Fliess", "paragraph", "Fliesstext", ["Fett"], None, False, False),
    ("cedar", "TitleOne", "paragraph", "Main", ["title-one"], 0, False, False),
    ("cedar", "Second", "paragraph", "Second", [], 1, False, False),
    ("cedar", "ThirdStyle", "paragraph", "third", [], None, False, False),
    ("cedar", "Orphan", "paragraph", "Orphan", [], None, False, False),
    ("cedar", "Emph", "character", "fett", [], None, False, False),
    ("delta", "Base", "paragraph", "base", ["Normal"], None, False, True),
    ("delta", "L1", "paragraph", "Heading 1", [], 0, False, False),
    ("delta", "L2", "paragraph", "Heading 2", [], 1, False, False),
    ("delta", "L3", "paragraph", "Heading 3", [], 2, False, False),
    ("delta", "L4", "paragraph", "Heading 4", [], 3, False, False),
    ("delta", "L4b", "paragraph", "Deep", [], 3, False, False),
    ("delta", "DefaultParagraphFont", "character", "Standard Font", [], None, False, False),
    ("delta", "TableNormal", "table", "Plain", [], None, False, False),
]
# (pack_id, level, style_id): headings the packs really use.
PACK_AUTHORITY = [
    ("atlas", 0, "Heading1"), ("atlas", 1, "Heading2"), ("atlas", 2, "Heading3"),
    ("birch", 0, "H1"), ("birch", 1, "H2"),
    ("cedar", 0, "TitleOne"),
    ("delta", 0, "L1"), ("delta", 1, "L2"), ("delta", 2, "L3"), ("delta", 3, "L4b"),
]
# (pack_id, style_id, num_id, level, level_text, start)
PACK_RULES = [
    ("atlas", "Heading1", "11", 0, "%1", 1), ("atlas", "Heading2", "11", 1, "%1.%2", 1),
    ("atlas", "Heading3", "11", 2, "%1.%2.%3", 1),
    ("birch", "H1", "7", 0, "%1.", 3), ("birch", "Title3", "8", 2, "%3", 1),
    ("delta", "L1", "4", 0, "第%1章", 1), ("delta", "L2", "4", 1, "%1.%2", 2),
]
# Lists of the packs: (pack_id, num_id, abstract_id), (pack_id, abstract_id), and their levels
# (pack_id, abstract_id, ilvl, start, num_fmt, lvl_text, left, hanging, tab).
PACK_NUMS = [("atlas", "11", "0"), ("birch", "7", "1"), ("birch", "8", "2"), ("delta", "4", "0")]
PACK_ABSTRACTS = [("atlas", "0"), ("birch", "1"), ("birch", "2"), ("delta", "0")]
PACK_LEVELS = [
    ("atlas", "0", 0, 1, "decimal", "%1", 432, 432, 432), ("atlas", "0", 1, 1, "decimal", "%1.%2", 576, 576, 576),
    ("atlas", "0", 2, 1, "decimal", "%1.%2.%3", 720, 720, 720),
    ("birch", "1", 0, 3, "decimal", "%1.", 360, 360, None), ("birch", "2", 2, 1, "decimal", "%3", 360, 360, None),
    ("delta", "0", 0, 1, "decimal", "第%1章", 0, 0, None), ("delta", "0", 1, 2, "decimal", "%1.%2", 200, 200, None),
]
# (pack_id, used_styles, preferred)
PACK_TABLES = [("atlas", ["GridA"], "GridA"), ("birch", ["Tab"], "Tab"), ("cedar", [], None), ("delta", [], None)]
# (pack_id, idx, width, height)
PACK_LAYOUTS = [
    ("atlas", 0, 11906, 16838), ("atlas", 1, 16838, 11906), ("birch", 0, 12240, 15840),
    ("cedar", 0, 11906, 16838), ("cedar", 1, 8392, 11907), ("cedar", 2, 16838, 11906),
    ("delta", 0, 14572, 20639),
]
# (pack_id, style_id, ind, spacing, jc) as attribute text
PACK_PROFILES = [
    ("atlas", "Heading1", "left=0;hanging=0", "before=240;after=60", "center"),
    ("atlas", "Heading2", "left=120;hanging=0", None, None),
    ("atlas", "Heading3", "left=240;hanging=0", None, None),
    ("birch", "H1", None, "before=360", None),
    ("birch", "Body", "left=0;hanging=0", None, None),
    ("delta", "L1", "left=0;firstLine=240", None, "left"),
]
# (pack_id, tag, value)
PACK_SETTINGS = [
    ("atlas", "defaultTabStop", "420"), ("atlas", "defaultTableStyle", "GridA"), ("atlas", "zoom", "100"),
    ("birch", "defaultTabStop", "708"), ("birch", "decimalSymbol", ","),
    ("cedar", "themeFontLang", "de-DE"), ("delta", "mirrorMargins", "1"), ("delta", "rsids", "x"),
]


def literal(value, engine: str) -> str:
    """SQL literal of a Python value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    items = [literal(v, engine) for v in (value if isinstance(value, list) else [])]
    if isinstance(value, list):
        if engine == "spark":
            return "cast(array(" + ", ".join(items) + ") as array<string>)"
        return "CAST([" + ", ".join(items) + "] AS VARCHAR[])"
    pairs = [x for k, v in value.items() for x in (literal(k, engine), _attrs(v) if isinstance(v, dict) else literal(v, engine))]
    return "cast(map(" + ", ".join(pairs) + ") as map<string,map<string,string>>)"


def _attrs(attrs: dict) -> str:
    pairs = [x for k, v in attrs.items() for x in (literal(k, "spark"), literal(v, "spark"))]
    return "cast(map(" + ", ".join(pairs) + ") as map<string,string>)"


def values(rows, columns: str, engine: str) -> str:
    """``SELECT`` over literal rows; ``columns`` is "name type, ..."."""
    names = [c.split()[0] for c in columns.split(",")]
    types = [c.split()[1] for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(literal(v, engine) for v in row) + ")" for row in rows)
    cast = ", ".join(f"CAST({n} AS {_type(t, engine)}) AS {n}" for n, t in zip(names, types))
    return f"SELECT {cast} FROM (VALUES {body}) AS v({', '.join(names)})"


def _type(name: str, engine: str) -> str:
    if engine == "spark":
        return {"strings": "array<string>", "bag": "map<string,map<string,string>>"}.get(name, name)
    return {"strings": "VARCHAR[]", "string": "VARCHAR"}.get(name, name)


def sheet_rows(with_bags: bool) -> list[tuple]:
    rows = []
    for lang, sheet in TARGET_SHEETS.items():
        if with_bags:
            rows.append((lang, -1, None, None, None, [], None, None, False, *DOC_DEFAULTS))
        for ord_, (sid, kind, name, aliases, based, level, default, ppr, rpr) in enumerate(sheet):
            row = (lang, ord_, sid, kind, name, aliases, based, level, default)
            rows.append(row + (ppr, rpr) if with_bags else row)
    return rows


SHEET_COLUMNS = (
    "lang string, ord int, style_id string, style_type string, name string, aliases strings, "
    "based_on string, own_outline int, is_default boolean"
)


def prop_rows() -> list[tuple]:
    """Properties of the sheets in long form, one row per attribute; a property
    without attributes gives one row with a NULL attribute."""
    rows = []

    def add(lang, style_id, bag, props):
        for prop, attrs in props.items():
            for a, v in (attrs or {None: None}).items():
                rows.append((lang, style_id, bag, prop, a, v))

    for lang, sheet in TARGET_SHEETS.items():
        add(lang, "", "p", DOC_DEFAULTS[0])
        add(lang, "", "r", DOC_DEFAULTS[1])
        for s in sheet:
            add(lang, s[0], "p", s[7])
            add(lang, s[0], "r", s[8])
    return rows
