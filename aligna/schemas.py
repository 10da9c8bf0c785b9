"""Row types as DDL."""

UNITS = "doc_id long, seq long, unit_id string, part string, path string, source_text string, translated_text string, style_name string, context_before string, context_after string, term_hits array<string>, tm_hit boolean, tm_match_type string, tm_similarity double, error string"
GLOSSARY = "ord long, source_term string, target_term string, domain string, project_id string, case_sensitive boolean, notes string, active boolean"
MEMORY = "ord long, source_text string, target_text string, source_doc string, confirmed boolean, hit_count long"
ISSUES = "severity string, category string, unit_id string, detail string, source_snippet string, target_snippet string"
STATUS = "filename string, status string, output string, drive_link string, units long, errors long, warnings long, cjk_residue long, tm_hits long, elapsed_seconds double, translated_at string, error string"
PARTS = ["header", "body", "table", "footer", "textbox", "footnote", "endnote"]
TASK_STATES = ["received", "extracting", "translating", "qa_checking", "writing_output", "completed", "failed"]
