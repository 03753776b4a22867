"""Explicit schemas of the tables; nothing is inferred."""

CASE = (
    "id string, language string, customer_name string, customer_email string, subject string, body string, "
    "expected_support boolean, expected_category string, expected_risk string, "
    "expected_sources array<string>, tags array<string>"
)
ATTACHMENT = (
    "filename string, content_type string, size_bytes bigint, text_preview string, parse_status string, "
    "status_message string"
)
MESSAGE = (
    "id string, provider string, provider_message_id string, customer_name string, customer_email string, "
    f"subject string, body string, attachments array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in ATTACHMENT.split(','))}>>, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
DOCUMENT = (
    "id string, title string, source string, content_hash string, status string, status_message string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
CHUNK = (
    "document_id string, position int, title string, source string, category string, content string, "
    "token_estimate int, page_number int, section_title string, embedding_model string, embedding array<double>"
)
VERSION = (
    "document_id string, version_number bigint, title string, source string, content_hash string, "
    "content_snapshot string, chunk_count int, status string, note string, created_at timestamp_ntz"
)
OPERATION_LOG = (
    "scope string, action string, title string, summary string, detail string, created_at timestamp_ntz"
)
OCR_WORD = (
    "doc_id bigint, page int, block int, par int, line int, word int, left int, top int, width int, height int, "
    "conf double, text string"
)
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
