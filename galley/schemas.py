"""Table schemas. Every reader states its schema; nothing is inferred."""

BAG = "map<string,map<string,string>>"

MEMBERS = (
    "pkg_id string, name string, ord int, file_size bigint, compress_size bigint, "
    "compress_type int, flag_bits int, is_dir boolean, content binary, fault string"
)
NODES = (
    "part string, kind string, ord bigint, parent_ord bigint, style_id string, has_bag boolean, "
    f"bag {BAG}, in_table boolean, plain boolean, revised boolean, text string"
)
STYLES = (
    "ord int, style_id string, style_type string, name string, aliases array<string>, "
    f"based_on string, own_outline int, is_default boolean, ppr {BAG}, rpr {BAG}, tpr {BAG}"
)
NUMBERING = (
    "kind string, ord int, abstract_id string, num_id string, num_style_link string, nsid string, "
    "ilvl int, start int, num_fmt string, lvl_text string, lvl_restart int, pstyle string, "
    "fonts map<string,string>, ind map<string,string>, tab_pos int, start_override int, "
    "has_lvl boolean"
)
RELS = (
    "ord int, base_part string, rel_id string, rel_type string, target string, target_mode string"
)
THEME = "kind string, ord int, grp string, script string, value string"
FONTS = "ord int, name string, alt_name string"
SETTINGS = "ord int, tag string, attrs map<string,string>"
EDITS = "pack_id string, style_id string, field string, value string, seq int"

RULE = "num_id string, level int, number_format string, level_text string, start int"
PROFILE = "ind map<string,string>, spacing map<string,string>, jc string"

MANIFEST = f"""
schema_version int, id string, name string, created_at string,
used_formats array<struct<
  style_id:string, name:string, type:string, usage_count:bigint, inferred:boolean,
  configured:boolean, inference_label:string, usage_by_story:map<string,bigint>, sample:string,
  font_latin:string, font_east_asia:string, size_pt:double, bold:boolean, italic:boolean,
  color_hex:string, alignment:string, space_before_pt:double, space_after_pt:double,
  line_spacing:double, line_rule:string, left_indent_pt:double, right_indent_pt:double,
  first_line_indent_pt:double, hanging_indent_pt:double, left_indent_chars:double,
  right_indent_chars:double, first_line_indent_chars:double, hanging_indent_chars:double,
  outline_level:int, numbered:boolean, numbering_level:int, numbering_format:string,
  numbering_pattern:string, numbering_example:string, numbering_start:int,
  numbering_restart:boolean, table_fill_hex:string, table_accent_hex:string,
  table_border_style:string, table_border_color_hex:string, table_border_width_pt:double,
  table_cell_margin_top_pt:double, table_cell_margin_bottom_pt:double,
  table_cell_margin_left_pt:double, table_cell_margin_right_pt:double,
  font_latin_aliases:array<string>, font_east_asia_aliases:array<string>>>,
used_style_count bigint, inferred_style_count bigint, custom_style_count bigint,
defined_style_count bigint, hidden_style_count bigint, format_part_count bigint,
inferred_heading_styles array<string>, heading_authorities map<string,string>,
heading_completion_warnings array<string>,
heading_numbering map<string,struct<num_id:string,level:int,number_format:string,
  level_text:string,start:int>>,
heading_numbering_user_edits map<string,map<string,string>>,
heading_paragraph_indents map<string,map<string,string>>,
heading_paragraph_properties map<string,struct<ind:map<string,string>,
  spacing:map<string,string>,jc:string>>,
heading_numbering_conflicts array<string>, used_table_styles array<string>,
preferred_table_style string,
manual_formatting struct<paragraph_count:bigint,run_count:bigint>,
document_summary struct<paragraph_count:bigint,run_count:bigint,table_count:bigint,
  section_count:bigint>,
page_layout struct<width_cm:double,height_cm:double,orientation:string,margin_top_cm:double,
  margin_bottom_cm:double,margin_left_cm:double,margin_right_cm:double>,
section_layouts array<array<string>>, privacy map<string,boolean>,
part_sha256 map<string,string>, format_fingerprint string
"""
