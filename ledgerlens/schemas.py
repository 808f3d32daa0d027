"""Declared schemas of the stored tables (Spark DDL).  Nothing is inferred."""

TABLES = {
    "companies": "company_id string, name string, ticker string, sector string, industry string",
    "reports": (
        "report_id string, company_id string, report_type string, year int, quarter int, "
        "total_pages int, status string, completed_stage string, failed_stage string, "
        "error_message string, retry_count int, uploaded_at timestamp"
    ),
    "pages": "report_id string, page_number int, page_text string",
    "sections": (
        "section_id string, report_id string, section_name string, "
        "normalized_section_name string, start_page int, end_page int, content string, "
        "confidence_score decimal(4,3)"
    ),
    "chunks": (
        "chunk_id string, report_id string, section_id string, chunk_index int, "
        "chunk_text string, token_count int, start_page int, end_page int, "
        "metadata struct<company:string,report_type:string,year:int,quarter:int,"
        "section_name:string,normalized_section_name:string,start_page:int,end_page:int,"
        "report_id:string,section_id:string>, embedding array<float>, embedding_status string"
    ),
    "metrics": (
        "metric_id string, report_id string, company_id string, source_chunk_id string, "
        "metric_name string, normalized_metric_name string, metric_category string, "
        "value decimal(22,6), currency string, unit string, fiscal_year int, "
        "fiscal_quarter int, confidence_score decimal(4,3), extraction_method string, "
        "source_text string"
    ),
    "comparisons": (
        "metric_id string, company_id string, metric_name string, comparison_type string, "
        "current_period string, previous_period string, current_value decimal(22,6), "
        "previous_value decimal(22,6), absolute_change decimal(22,6), "
        "percentage_change decimal(18,2), flags array<string>"
    ),
    "risks": (
        "risk_id string, company_id string, report_id string, source_chunk_id string, "
        "risk_name string, normalized_risk_name string, risk_description string, "
        "category string, severity string, confidence_score decimal(4,3)"
    ),
    "tones": (
        "tone_id string, company_id string, report_id string, source_chunk_id string, "
        "source_type string, seq int, sentiment string, confidence_level string, "
        "hedging_score double, positive_score double, negative_score double, "
        "confidence_score double, extraction_method string, source_text string"
    ),
    "metric_candidates": (
        "metric_name string, value string, unit string, currency string, period string, "
        "confidence string"
    ),
    "risk_candidates": (
        "risk_name string, risk_description string, category string, severity string, "
        "confidence string"
    ),
    "tone_candidates": (
        "sentiment string, confidence_level string, hedging_strength string, "
        "positive_strength string, negative_strength string, confidence string"
    ),
    "file_meta": "path string, filename string, content_type string, length bigint, head string",
}
