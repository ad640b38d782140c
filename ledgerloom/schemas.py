"""Declared schemas of the stored tables; nothing is inferred."""

VENDORS = "vendor_id bigint, vendor_name string, tax_id string, active boolean"
RECORDS = "record_id bigint, vendor_id bigint, reference string, reference_key string, currency string, amount_minor bigint, issued_on string, source_file string"
DOCUMENTS = "id bigint, digest string, path string, route string, read_at timestamp"
FIELDS = "document_id bigint, key string, type string, value_text string, value_minor bigint, admitted boolean, check_failed string, confidence double, width string, source string"
RECONCILIATIONS = "id bigint, document_id bigint, record_id bigint, decision string, variance bigint, computed_at timestamp, checks array<struct<name:string,outcome:string,detail:string>>"
REGIONS = "doc_id string, idx int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double, source string"
INFERENCE_LOG = (
    "ts timestamp, platform string, op string, model string, event string, gen_ms bigint, ocr_ms bigint, load_ms bigint, detect_ms bigint, recognize_ms bigint, "
    "ttft_ms double, tok_per_sec double, prompt_tokens bigint, completion_tokens bigint, cache_tokens bigint, blocks bigint, tool_calls bigint, tool_errors bigint, seed bigint, "
    "backend_device string, stop_reason string, metrics_source string, error string"
)
#: Field template of an invoice: (pos, key, type, label).
INVOICE = (
    (0, "vendor", "string", "Vendor"),
    (1, "invoice_no", "string", "Invoice"),
    (2, "date", "date", "Date"),
    (3, "subtotal", "amount", "Subtotal"),
    (4, "tax", "amount", "Tax"),
    (5, "tax_rate", "integer", "Tax rate"),
    (6, "total", "amount", "Total due"),
    (7, "currency", "string", "Currency"),
)
