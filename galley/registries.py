"""Names, limits and enumerations that results depend on."""

# Package part roles.
FORMAT_ROLES = ("styles", "stylesWithEffects", "theme", "fontTable", "numbering")
ROLE_DEFAULT_PART = {
    "styles": "word/styles.xml",
    "stylesWithEffects": "word/stylesWithEffects.xml",
    "theme": "word/theme/theme1.xml",
    "fontTable": "word/fontTable.xml",
    "numbering": "word/numbering.xml",
}
ROLE_ROOT_TAG = {
    "styles": "styles",
    "stylesWithEffects": "styles",
    "theme": "theme",
    "fontTable": "fonts",
    "numbering": "numbering",
}
BODY_PART = "word/document.xml"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
OFFICE_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
ROLE_REL_TYPE = {
    "styles": OFFICE_REL + "/styles",
    "stylesWithEffects": "http://schemas.microsoft.com/office/2007/relationships/stylesWithEffects",
    "theme": OFFICE_REL + "/theme",
    "fontTable": OFFICE_REL + "/fontTable",
    "numbering": OFFICE_REL + "/numbering",
}
_OOXML = "application/vnd.openxmlformats-officedocument."
PART_CONTENT_TYPE = {
    "styles": _OOXML + "wordprocessingml.styles+xml",
    "stylesWithEffects": "application/vnd.ms-word.stylesWithEffects+xml",
    "theme": _OOXML + "theme+xml",
    "fontTable": _OOXML + "wordprocessingml.fontTable+xml",
    "numbering": _OOXML + "wordprocessingml.numbering+xml",
    "settings": _OOXML + "wordprocessingml.settings+xml",
}
DEFAULT_CONTENT_TYPES = {
    "xml": ("application/xml", "text/xml"),
    "rels": ("application/vnd.openxmlformats-package.relationships+xml",),
}

# Accepted files and required members.
SOURCE_SUFFIXES = ("docx", "docm", "dotx", "dotm")
TARGET_SUFFIXES = ("docx", "docm")
PACK_SUFFIX = "wfstyle"
PACK_PART_PREFIX = "parts/"
PACK_SCHEMA_VERSION = 1
REQUIRED_PARTS = ("[Content_Types].xml", "word/document.xml", "word/styles.xml")
REQUIRED_PACK_PARTS = (
    "[Content_Types].xml",
    "word/styles.xml",
    "word/_rels/document.xml.rels",
)

# Parts that carry content.
CONTENT_PART_PATTERN = (
    r"^word/(document|header\d*|footer\d*|footnotes|endnotes|comments|glossary/document)\.xml$"
)

# Size limits in bytes and counts.
MIB = 1024 * 1024
MAX_MEMBERS = 10_000
MAX_TOTAL_BYTES = 1024 * MIB
MAX_MEMBER_BYTES = 512 * MIB
MAX_XML_BYTES = 64 * MIB
MAX_RATIO = 1000
RATIO_FLOOR_BYTES = MIB
MAX_NAME_BYTES = 1024
STORED, DEFLATED = 0, 8
MAX_PACKAGE_FILE_BYTES = MAX_TOTAL_BYTES + 16 * MIB
MAX_PACK_MEMBERS = 256
MAX_PACK_MEMBER_BYTES = 16 * MIB
MAX_PACK_TOTAL_BYTES = 64 * MIB
MAX_PACK_FILE_BYTES = MAX_PACK_TOTAL_BYTES + 2 * MIB
MAX_EDIT_BYTES = MIB
MAX_EDIT_STYLES = 256
MAX_NAME_LENGTH = 120
MAX_FONT_ALIASES = 64
MAX_STEM = 48

# Properties that survive when direct formatting is dropped.
RUN_KEEP = (
    "rStyle", "rtl", "cs", "lang", "noProof", "vanish", "specVanish", "webHidden",
    "vertAlign", "oMath",
)
TABLE_KEEP = (
    "tblStyle", "tblW", "tblInd", "tblLayout", "tblLook", "tblOverlap", "tblpPr",
    "bidiVisual",
)
ROW_KEEP = (
    "cantSplit", "tblHeader", "gridBefore", "gridAfter", "wBefore", "wAfter",
    "cnfStyle", "hidden",
)
CELL_KEEP = (
    "tcW", "gridSpan", "hMerge", "vMerge", "textDirection", "tcFitText", "noWrap",
    "hideMark", "cnfStyle",
)
PARAGRAPH_KEEP = ("pStyle", "sectPr")
SECTION_TAGS = (
    "pgSz", "pgMar", "paperSrc", "pgBorders", "lnNumType", "pgNumType", "cols",
    "formProt", "vAlign", "noEndnote", "titlePg", "textDirection", "bidi", "rtlGutter",
    "docGrid",
)
SETTINGS_TAGS = (
    "defaultTableStyle", "defaultTabStop", "characterSpacingControl", "themeFontLang",
    "decimalSymbol", "listSeparator", "evenAndOddHeaders", "mirrorMargins", "gutterAtTop",
    "bordersDoNotSurroundHeader", "bordersDoNotSurroundFooter", "alignBordersAndEdges",
    "displayBackgroundShape",
)
FORBIDDEN_TAGS = (
    "embedRegular", "embedBold", "embedItalic", "embedBoldItalic", "numPicBullet",
    "lvlPicBulletId", "drawing", "pict", "object", "altChunk", "document", "body", "p", "r",
    "t", "instrText", "tbl", "blip", "blipFill",
)

# Schema order of paragraph and run properties.
PARAGRAPH_ORDER = (
    "pStyle", "keepNext", "keepLines", "pageBreakBefore", "framePr", "widowControl",
    "numPr", "suppressLineNumbers", "pBdr", "shd", "tabs", "suppressAutoHyphens", "kinsoku",
    "wordWrap", "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN", "bidi",
    "adjustRightInd", "snapToGrid", "spacing", "ind", "contextualSpacing", "mirrorIndents",
    "suppressOverlap", "jc", "textDirection", "textAlignment", "textboxTightWrap",
    "outlineLvl", "divId", "cnfStyle",
)
RUN_ORDER = (
    "rStyle", "rFonts", "b", "bCs", "i", "iCs", "caps", "smallCaps", "strike", "dstrike",
    "outline", "shadow", "emboss", "imprint", "noProof", "snapToGrid", "vanish",
    "webHidden", "color", "spacing", "w", "kern", "position", "sz", "szCs", "highlight",
    "u", "effect", "bdr", "shd", "fitText", "vertAlign", "rtl", "cs", "em", "lang",
    "eastAsianLayout", "specVanish", "oMath",
)

# Indent and spacing attributes in schema order.
INDENT_ATTRS = (
    "left", "start", "leftChars", "startChars", "right", "end", "rightChars", "endChars",
    "firstLine", "firstLineChars", "hanging", "hangingChars",
)
INDENT_GROUPS = (
    ("left", "start"),
    ("leftChars", "startChars"),
    ("right", "end"),
    ("rightChars", "endChars"),
    ("firstLine",),
    ("firstLineChars",),
    ("hanging",),
    ("hangingChars",),
)
SPACING_INT_ATTRS = ("before", "beforeLines", "after", "afterLines", "line")
SPACING_FLAG_ATTRS = ("beforeAutospacing", "afterAutospacing")
SPACING_ATTRS = (
    "before", "beforeLines", "beforeAutospacing", "after", "afterLines",
    "afterAutospacing", "line", "lineRule",
)
LINE_RULES = ("auto", "atLeast", "exact")
ALIGNMENTS = (
    "both", "center", "distribute", "end", "highKashida", "left", "lowKashida",
    "mediumKashida", "numTab", "right", "start", "thaiDistribute",
)

# Names that mark the default style of a type when none is flagged.
DEFAULT_STYLE_NAMES = {
    "paragraph": ("Normal", "正文"),
    "character": ("DefaultParagraphFont", "默认段落字体"),
    "table": ("TableNormal", "普通表格"),
}
BODY_NAMES = ("normal", "正文", "bodytext")

# Edit fields by family, and their enumerations.
RUN_FIELDS = ("font_east_asia", "font_latin", "size_pt", "bold", "color_hex")
PARAGRAPH_FIELDS = (
    "alignment", "space_before_pt", "space_after_pt", "line_spacing", "line_rule",
    "left_indent_pt", "right_indent_pt", "first_line_indent_pt", "hanging_indent_pt",
    "left_indent_chars", "right_indent_chars", "first_line_indent_chars",
    "hanging_indent_chars",
)
NUMBERING_FIELDS = (
    "numbering_format", "numbering_pattern", "numbering_start", "numbering_restart",
)
TABLE_FIELDS = (
    "table_fill_hex", "table_accent_hex", "table_border_style", "table_border_color_hex",
    "table_border_width_pt", "table_cell_margin_top_pt", "table_cell_margin_bottom_pt",
    "table_cell_margin_left_pt", "table_cell_margin_right_pt",
)
EDIT_FIELDS = RUN_FIELDS + PARAGRAPH_FIELDS + NUMBERING_FIELDS + TABLE_FIELDS
NUMBER_FORMATS = (
    "decimal", "decimalZero", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter",
    "chineseCounting", "chineseCountingThousand", "chineseLegalSimplified",
    "ideographTraditional",
)
BORDER_STYLES = (
    "nil", "none", "single", "double", "dotted", "dashed", "dotDash", "dotDotDash",
)
# Fixed values: (minimum, maximum, step) of numeric edit fields.
EDIT_RANGES = {
    "size_pt": (5.0, 200.0, 0.5),
    "table_border_width_pt": (0.25, 12.0, 0.125),
    "table_cell_margin_top_pt": (0.0, 1584.0, 0.05),
    "table_cell_margin_bottom_pt": (0.0, 1584.0, 0.05),
    "table_cell_margin_left_pt": (0.0, 1584.0, 0.05),
    "table_cell_margin_right_pt": (0.0, 1584.0, 0.05),
    "numbering_start": (1.0, 32767.0, 1.0),
    "space_before_pt": (0.0, 1584.0, 0.05),
    "space_after_pt": (0.0, 1584.0, 0.05),
    "left_indent_pt": (-1584.0, 1584.0, 0.05),
    "right_indent_pt": (-1584.0, 1584.0, 0.05),
    "first_line_indent_pt": (0.0, 1584.0, 0.05),
    "hanging_indent_pt": (0.0, 1584.0, 0.05),
    "left_indent_chars": (-100.0, 100.0, 0.01),
    "right_indent_chars": (-100.0, 100.0, 0.01),
    "first_line_indent_chars": (0.0, 100.0, 0.01),
    "hanging_indent_chars": (0.0, 100.0, 0.01),
}

# Chinese digits and units.
HAN_DIGITS = {
    "零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6,
    "七": 7, "八": 8, "九": 9,
}
HAN_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
# Which chapter words belong to which heading level.
HAN_HEADING_UNITS = {0: "章篇部卷", 1: "节", 2: "条款项"}

# Generated style ids and names.
WRAPPER_PREFIX = "WordFormatTableNoIndent"
WRAPPER_NAME = "表格正文（无首行缩进）"

# Manifest fields that decide whether two packs apply the same format.
IDENTITY_FIELDS = (
    "section_layouts", "heading_authorities", "heading_numbering",
    "heading_numbering_user_edits", "heading_paragraph_indents",
    "heading_paragraph_properties", "used_table_styles", "preferred_table_style",
)

# What a pack keeps of its source.
PACK_PRIVACY = {
    "source_path_stored": False, "source_file_name_stored": False, "source_text_stored": False,
    "source_media_stored": False, "embedded_fonts_stored": False, "generic_samples_only": True,
    "display_name_derived_from_source": True,
}

# What a member is for, by name; the first pattern that fits.
MEMBER_KINDS = (
    ("rels", r"(^|/)_rels/[^/]+\.rels$"),
    ("styles", r"^word/styles[^/]*\.xml$"),
    ("numbering", r"^word/numbering[^/]*\.xml$"),
    ("theme", r"^word/theme/[^/]+\.xml$"),
    ("fonts", r"^word/fontTable[^/]*\.xml$"),
    ("settings", r"^word/settings[^/]*\.xml$"),
    ("content", r"^word/[^/]+\.xml$"),
)
