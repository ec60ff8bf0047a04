"""Names, lists, patterns and texts that results must reproduce exactly."""

from __future__ import annotations

# --- Fixed values: states -------------------------------------------------------------
PENDING, NEEDS_REVIEW, APPROVED, REJECTED, ERROR = (
    "pending", "needs_review", "approved", "rejected", "error")
DOCUMENT_STATUSES = [PENDING, NEEDS_REVIEW, APPROVED, REJECTED, ERROR]
QUEUED, RUNNING, SUCCEEDED, FAILED = "queued", "running", "succeeded", "failed"
JOB_STATUSES = [QUEUED, RUNNING, SUCCEEDED, FAILED]
DISCOVERY, AUTO_DETECT, TEMPLATE = "discovery", "auto_detect", "template"

# --- Fixed values: formats ------------------------------------------------------------
TEXT_SUFFIXES, TEXT_TYPES = [".txt", ".md"], ["text/plain", "text/markdown"]
CSV_SUFFIXES, CSV_TYPES = [".csv"], ["text/csv", "application/csv"]
JSON_SUFFIXES, JSON_TYPES = [".json"], ["application/json"]
PDF_SUFFIXES, PDF_TYPES = [".pdf"], ["application/pdf"]
PREVIEWABLE_PARSERS = ["plain_text", "raw_text", "markdown", "json", "csv"]
PREVIEWABLE_TYPES = ["application/json", "text/csv", "application/csv"]
MODEL_PARSERS = ["raw_text", "markdown", "pdf_text"]
CSV_MARKER = "CSV_JSON_RECORDS:"
UNSUPPORTED_REASON = "Unsupported file type. MVP supports: .csv, .json, .md, .pdf, .txt."
EMPTY_REASON = "Document text is empty."
INVALID_JSON_REASON = "Invalid JSON"
NO_PAGE_TEXT_REASON = (
    "No selectable text found in PDF. Scanned PDFs/images need OCR, which is currently unavailable.")

# --- Fixed values: patterns (ASCII classes, no look-around) ----------------------------
EMAIL_FIND = r"[A-Za-z0-9_.%-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}"
EMAIL_FULL = r"^[A-Za-z0-9_.%+\-]+@[A-Za-z0-9_.\-]+\.[A-Za-z]{2,}$"
AMOUNT_FIND = r"(?i)(?:RM|MYR|USD|EUR|GBP|\$)\s?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?"
DATE_FIND = r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})\b"
PHONE_FIND = (
    r"\b(?:\+?[0-9]{1,3}[-.\s]?)?(?:\(?[0-9]{2,4}\)?[-.\s]?)?[0-9]{3,4}[-.\s]?[0-9]{4}\b")
RUN_METADATA = r"(?i)AI provider=([^,]+), model=([^\.]+)\."
RUN_PREFIX = r"(?i)^AI provider=[^,]+, model=[^.]+\.\s*"
LABEL_PREFIX = r"^\s*(?:[-*•]\s*)?(?:[0-9]+[.)]\s*)?"
LABEL_SEPARATOR = r"\s*(?::|=|-|–|—)\s*"
LINE_BREAK = r"\r\n|\n|\r"
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "d/M/yy", "d-M-yy"]

# --- Fixed values: classifier ------------------------------------------------------------
PARSER_CLASSES = [
    ("csv", "structured_csv", 0.92, "CSV parser normalized rows and columns before extraction."),
    ("json", "structured_json", 0.92,
     "JSON parser validated and pretty-printed the object before extraction."),
    ("pdf_text", "text_pdf", 0.86, "PDF parser extracted selectable text from pages."),
]
KEYWORD_CLASSES = [
    (["invoice", "amount due", "subtotal", "tax"],
     "invoice_or_receipt", 0.82, "Financial keywords were detected."),
    (["contract", "agreement", "effective date", "termination"],
     "contract_or_agreement", 0.78, "Agreement-related keywords were detected."),
    (["error", "traceback", "exception", "warning"],
     "technical_log", 0.76, "Log/error keywords were detected."),
]
DEFAULT_CLASS = ("general_document", 0.62, "No strong domain-specific indicators were found.")

# --- Fixed values: reasons written next to extracted fields ------------------------------
SUMMARY_REASON = "Brief extractive summary generated from the first meaningful lines."
EMAIL_REASON = "Regex matched a valid email-like token."
AMOUNT_REASON = "Currency pattern detected in the source text."
DATE_REASON = "Date-like pattern detected."
PHONE_REASON = "Number pattern detected; may be a phone, account, or reference number."
NO_FIELDS_VALUE = "No high-confidence business fields found."
NO_FIELDS_REASON = "The document can still be reviewed and corrected by a human."
CSV_CELL_REASON = "Directly copied from parsed CSV; no AI inference required."
CSV_BLANK_REASON = "CSV field was present but empty, so it remains reviewable."
JSON_LEAF_REASON = "Directly copied from validated JSON; no inference required."
JSON_ITEM_REASON = "Directly copied top-level JSON array item; no inference required."
JSON_SCALAR_REASON = "Directly copied JSON scalar value."
DATASET_REASONS = {
    "csv": ["CSV parsed successfully into structured rows.",
            "Summary derived from parsed CSV row and column counts.",
            "Counted parsed CSV records.",
            "Collected CSV column headers.",
            "CSV rows represent a collection of structured records."],
    "json": ["Valid JSON array parsed successfully.",
             "Summary derived from JSON array length and object keys.",
             "Counted top-level JSON array items.",
             "Collected unique keys from JSON object records.",
             "Top-level JSON array indicates a collection of structured records."],
}
OBJECT_REASONS = ["Valid JSON object parsed successfully.",
                  "Summary derived from JSON object keys.",
                  "Collected keys from the top-level JSON object.",
                  "Valid scalar JSON parsed successfully."]
MISSING_SNIPPET = "Required template field was not found in the extracted data."
FALLBACK_ERROR_REASON = "Configured AI provider failed, so deterministic fallback was used."
FALLBACK_LIMIT_REASON = ("AI provider quota was exhausted, so deterministic fallback was used because "
                         "AI_DEFER_ON_RATE_LIMIT=false.")
MANUAL_SNIPPET = "Manually added by reviewer; not present as an AI-extracted field."
MANUAL_MARK = "Manually added by reviewer"
MANUAL_REASON = ("Manually added by reviewer because this field was absent from the extracted "
                 "fields. Not generated by AI.")
SUGGESTED = "suggested_extra_fields."

# --- Fixed values: validation --------------------------------------------------------------
DEFAULT_CURRENCIES = ["RM", "MYR", "USD", "EUR", "GBP", "$"]
DEFAULT_CODES = ["MYR", "RM", "USD", "EUR", "GBP", "SGD"]
VALIDATION_TEXT = {
    "missing": " is required by the selected template but no value was found.",
    "optional": "Optional field is empty.",
    "email": ("Valid email address.", "Value is not a valid email address."),
    "date": ("Valid date format.", "Value is not a supported date format."),
    "currency": ("Valid currency/amount value.",
                 "Value is not a valid currency/amount for this template field."),
    "currency_code": ("Valid currency code.", "Currency code must be one of: "),
    "percentage": ("Valid percentage between 0 and 100.",
                   "Percentage must be a number between 0 and 100."),
    "number": ("Valid numeric value.", "Value must be numeric."),
    "min_length": ("Value must contain at least ", " character(s)."),
    "pattern": "Value does not match the configured pattern.",
    "string": "Basic value check passed.",
}

# --- Fixed values: review ---------------------------------------------------------------------
DEFAULT_THRESHOLD = 0.80
REJECTION_REASONS = [
    ("incomplete_document", "Incomplete document"),
    ("wrong_document_type", "Wrong document type"),
    ("invalid_template", "Invalid template"),
    ("unsupported_format", "Unsupported or unreadable content"),
    ("duplicate_document", "Duplicate document"),
    ("poor_data_quality", "Poor data quality"),
    ("other", "Other"),
]
REFUSED_READONLY = "Rejected documents are view-only and cannot be modified."
REFUSED_LOCKED = ("Template field names are locked. Edit the value only so standardized client "
                  "schemas remain consistent.")
REFUSED_NAME = "field_name cannot be empty"
REFUSED_VALUE = "corrected_value cannot be empty"
REFUSED_ADD_NAME = "field_name is required"
REFUSED_ADD_VALUE = "value is required"
REFUSED_REMOVE = "Only suggested extra fields or manually added fields can be removed."
REFUSED_STATE = "This document cannot be rejected from its current state."
REFUSED_NO_FIELD = "Extraction not found"
REFUSED_NO_DOCUMENT = "Document not found"

# --- Fixed values: briefing -------------------------------------------------------------------
BRIEFING = {
    "missing": "Missing required fields: ",
    "low": "Low-confidence fields require review: ",
    "none": "No extracted fields were produced for this document.",
    "template": "Template context applied: ",
    "no_template": ("No template was enforced; fields were produced using Free Extraction or "
                    "parser-based discovery."),
    "ok_required": "No required template fields are currently missing.",
    "ok_validation": "No validation failures were detected by deterministic rules.",
    "issues": "Review the listed issues before approving this document.",
    "clean": ("No significant deterministic issues were detected. Review and approve if the "
              "extracted values match the source document."),
    "default_reason": "AI Review Assistant provider was disabled or skipped",
}
REVIEW_DEFAULT_SUMMARY = "No AI review summary was returned."
REVIEW_DEFAULT_RECOMMENDATION = (
    "Review the extracted fields and validation messages before approval.")
MODEL_DEFAULT_EXPLANATION = "Extracted by configured AI provider."
MODEL_OBJECT_ERROR = "AI provider did not return a valid JSON object."

# --- Fixed values: backlog ---------------------------------------------------------------------
BACKLOG_ACTIONS = {
    "deferred": "deferred_job_requeued",
    "stuck": "stuck_processing_job_requeued",
    "pending": "pending_job_requeued",
    "failed": "failed_job_requeued",
}
BACKLOG_ACTOR = "celery_recovery"
BACKLOG_MISSING = "Recovery skipped: document no longer exists."
BACKLOG_REJECTED = "Recovery skipped: document is rejected."

# --- Fixed values: display labels -----------------------------------------------------------
PARSER_LABELS = {
    "raw_text": "Text preview",
    "markdown": "Markdown/text preview",
    "pdf_text": "PDF text preview",
    "json": "Pretty JSON preview",
    "csv": "CSV table preview",
}
# --- Fixed values: audit texts of documents, jobs, fields and briefings (in braces: columns) ------------
AUDIT_TEXTS = {
    "document_created": "Raw input parsed via {parser_type}; document and durable processing job stored in PostgreSQL. "
                        "Mode: {extraction_mode}. ",
    "template_selected": "Template selected: {document_type_label}.",
    "no_template_selected": "No template selected; free discovery extraction will be used.",
    "job_queued": "Celery received only the PostgreSQL processing_jobs.id.",
    "field_manually_added": '{field_name}: manually added with value "{extracted_value}". Validation status: {validation_status}.',
    "field_removed": '{field_name}: removed from extracted fields. Previous display value was "{display_value}".',
    "processing_skipped_rejected_document": "Job {job_id} skipped because document #{doc_id} is rejected.",
    "processing_write_skipped_rejected_document": "Job {job_id} completed extraction work but skipped database writes because "
                                                  "document #{doc_id} was rejected.",
    "ai_rate_limited_job_deferred": "Job {job_id} kept pending because {provider}/{model} reached its {window_type} quota of {quota}. "
                                    "Next retry after {retry_at}.",
    "ai_review_assistant_completed": "AI Review Assistant generated reviewer briefing using {provider}/{model}.",
    "ai_review_assistant_fallback_created": "Deterministic AI Review Assistant fallback created. Reason: {reason}",
    "ai_review_assistant_deferred_or_skipped": "AI Review Assistant provider skipped because quota was reached: {error}",
    "ai_review_assistant_skipped": "AI Review Assistant provider failed non-fatally: {error}",
}

MODE_LABELS = {
    "auto_detect": "Auto-detect template",
    "discovery": "Free Extraction",
    "template": "Selected template",
}

# --- Fixed values: the four bundled templates -------------------------------------------------
_MONEY = {"min": 0.0, "currencies": ["RM", "MYR", "USD", "SGD"], "require_currency_symbol": False}
_DATE = {"formats": ["YYYY-MM-DD", "DD/MM/YYYY"]}
_TEXT = {"min_length": 1}
_CODE = {"allowed": ["MYR", "RM", "USD", "SGD", "EUR", "GBP"]}
# (field key, label, data type, required, aliases, rules); templates are in file-name order.
BUNDLED_TEMPLATES = [
    ("finance_bank_statement", "Finance: Bank Statement", "finance",
     ["bank statement", "statement", "account statement"], [
         ("account_number", "Account Number", "string", True,
          ["account", "acct no", "account no"], {"pattern": "^[0-9 -]{6,20}$", "min_length": 6}),
         ("account_holder_name", "Account Holder Name", "string", True,
          ["account holder", "customer", "name"], _TEXT),
         ("statement_start_date", "Statement Start Date", "date", True,
          ["period from", "start date"], _DATE),
         ("statement_end_date", "Statement End Date", "date", True,
          ["period to", "end date"], _DATE),
         ("opening_balance", "Opening Balance", "currency", False, ["beginning balance"], _MONEY),
         ("closing_balance", "Closing Balance", "currency", True,
          ["ending balance", "balance"], _MONEY),
         ("total_deposits", "Total Deposits", "currency", False, ["credits", "money in"], _MONEY),
         ("total_withdrawals", "Total Withdrawals", "currency", False,
          ["debits", "money out"], _MONEY),
         ("currency", "Currency", "currency_code", False, ["currency code"], _CODE),
     ]),
    ("finance_invoice", "Finance: Invoice", "finance", ["invoice", "tax invoice", "bill"], [
        ("invoice_number", "Invoice Number", "string", True,
         ["invoice no", "invoice #", "inv number", "reference"], _TEXT),
        ("supplier_name", "Supplier Name", "string", True, ["vendor", "seller", "supplier"], _TEXT),
        ("customer_name", "Customer Name", "string", False, ["client", "buyer", "customer"], _TEXT),
        ("invoice_date", "Invoice Date", "date", True, ["date", "billing date"], _DATE),
        ("due_date", "Due Date", "date", False, ["payment due", "due"], _DATE),
        ("subtotal_amount", "Subtotal Amount", "currency", False, ["subtotal"], _MONEY),
        ("tax_amount", "Tax Amount", "currency", False, ["tax", "sst", "gst", "vat"], _MONEY),
        ("total_amount", "Total Amount", "currency", True,
         ["total", "amount", "amount due", "invoice amount"], _MONEY),
        ("currency", "Currency", "currency_code", False, ["currency code"], _CODE),
        ("payment_reference", "Payment Reference", "string", False,
         ["reference number", "payment ref"], _TEXT),
    ]),
    ("construction_progress_claim", "Construction: Progress Claim", "construction",
     ["progress claim", "payment claim", "payment certificate"], [
         ("claim_number", "Claim Number", "string", True,
          ["claim no", "payment certificate no"], _TEXT),
         ("contract_number", "Contract Number", "string", True,
          ["contract no", "agreement number"], _TEXT),
         ("project_name", "Project Name", "string", True, ["project"], _TEXT),
         ("contractor_name", "Contractor Name", "string", True, ["contractor", "supplier"], _TEXT),
         ("claim_period_start", "Claim Period Start", "date", False, ["period from"], _DATE),
         ("claim_period_end", "Claim Period End", "date", True, ["period to"], _DATE),
         ("work_completed_percentage", "Work Completed %", "percentage", False,
          ["completion", "progress percentage"], {"min": 0.0, "max": 100.0}),
         ("claim_amount", "Claim Amount", "currency", True,
          ["amount claimed", "payment amount"], _MONEY),
         ("retention_amount", "Retention Amount", "currency", False, ["retention"], _MONEY),
         ("approved_amount", "Approved Amount", "currency", False, ["certified amount"], _MONEY),
     ]),
    ("construction_purchase_order", "Construction: Purchase Order", "construction",
     ["purchase order", "po", "material order"], [
         ("po_number", "PO Number", "string", True,
          ["purchase order number", "po #", "order number"], _TEXT),
         ("project_name", "Project Name", "string", True, ["project", "job name"], _TEXT),
         ("site_location", "Site Location", "string", True, ["site", "job site", "location"], _TEXT),
         ("supplier_name", "Supplier Name", "string", True, ["vendor", "supplier"], _TEXT),
         ("requested_by", "Requested By", "string", False, ["requester", "ordered by"], _TEXT),
         ("order_date", "Order Date", "date", True, ["date"], _DATE),
         ("delivery_date", "Delivery Date", "date", False, ["required by", "delivery"], _DATE),
         ("total_amount", "Total Amount", "currency", True,
          ["total", "amount", "order total"], _MONEY),
         ("cost_code", "Cost Code", "string", False, ["budget code", "cost center"], _TEXT),
     ]),
]
TEMPLATE_DESCRIPTIONS = {
    "finance_bank_statement":
        "Bank statement fields for account reconciliation and finance operations.",
    "finance_invoice": "Standard invoice fields commonly needed by finance/AP teams.",
    "construction_progress_claim":
        "Progress claim/payment certificate fields for construction contract administration.",
    "construction_purchase_order":
        "Procurement fields for construction materials, suppliers, and job-site purchasing.",
}
# Texts of the template instruction block.
CONTRACT_HEAD = "Extract values only for these canonical field keys. Return null/empty if absent."
CONTRACT_TAIL = ("Do not invent new official field names. If extra useful data appears, label it "
                 "clearly as a suggested extra field.")
