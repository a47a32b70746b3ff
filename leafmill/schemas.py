"""The engine's tables, as DDL. ``seq`` makes an order explicit; absent is null."""

PAGE = "source string, page int, text string, n_chars int"
TOC_ENTRY = "source string, seq int, family string, style string, marker string, marker_text string, id string, title string, printed_page int, level int"
SECTION = TOC_ENTRY + ", pdf_page int"
CHUNK = (
    "chunk_id string, source string, pdf_page int, section_path array<string>, section_ids array<string>, section_level int, chunk_type string, is_summary boolean, text string, "
    "parent_section_id string, sibling_sections array<string>, recommendation_id string, chunk_index int, chunk_total int, list_id string, list_index int, list_total int, list_type string, "
    "table_id string, table_title string, related_recommendations array<string>, related_tables array<string>, related_lists array<string>"
)
ENTITY = "chunk_id string, source string, pdf_page int, section_ids array<string>, section_path array<string>, chunk_type string, entities map<string,array<string>>"
TEMPLATE = "id string, template string, intent string, requires array<string>"
QUESTION = "query string, template_id string, intent string, entities map<string,string>, source string, pdf_page int, section_path array<string>, section_ids array<string>, source_chunk string"
RESULT = (
    "qid bigint, query string, intent string, level string, rank int, chunk_id string, source string, pdf_page int, section_path array<string>, chunk_type string, text string, "
    "match_score double, matched_query string, template_id string"
)


def names(ddl: str) -> list[str]:
    """The columns of a table."""
    return [column.split()[0] for column in ddl.split(", ")]
