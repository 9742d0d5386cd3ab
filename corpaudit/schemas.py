"""Fixed schemas of the paragraph tables; positions are data (p_idx, block_idx)."""

from __future__ import annotations

PROPS = "struct<alignment:string,spacing_before:int,spacing_after:int,line:int,line_rule:string,first_line_indent:int,hanging_indent:int,left_indent:int,contextual_spacing:boolean,page_break_before:boolean>"
RUN_PROPS = "struct<font_ascii:string,font_hansi:string,size_half_points:int,bold:boolean,italic:boolean,underline:boolean,all_caps:boolean>"
RUNS = f"array<struct<text:string,props:{RUN_PROPS},has_page_break:boolean,has_drawing:boolean>>"
PARAGRAPHS = (
    f"doc_id bigint, p_idx int, block_idx int, text string, style_id string, direct {PROPS}, props {PROPS}, run_props {RUN_PROPS}, runs {RUNS}, "
    "is_empty boolean, has_drawing boolean, page_break_after boolean, has_numbering boolean, has_sect_pr boolean, inside_table boolean, text_before_break string, text_after_break string"
)
STYLES = f"doc_id bigint, style_id string, name string, type string, based_on string, is_default boolean, p_pr {PROPS}, r_pr {RUN_PROPS}"
SECTIONS = "doc_id bigint, section_idx int, margin_top int, margin_bottom int, margin_left int, margin_right int, page_width int, page_height int"
DOC_TABLES = "doc_id bigint, table_idx int, block_idx int, rows int, cols int, first_cell_text string"
HEADERS_FOOTERS = "doc_id bigint, part string, kind string, ref_type string, text string, field_codes array<string>"
SETTINGS = "doc_id bigint, paper_type string, mode string, fix_citation_mechanics boolean, verify_metadata boolean, metadata struct<title:string,author:string,institution:string,course_number:string,course_name:string,instructor:string,due_date:string,running_head:string>, requirements_text string"
WORKS = "doi string, title string, authors array<struct<family:string,given:string>>, journal string, year string, volume string, issue string, pages string"
