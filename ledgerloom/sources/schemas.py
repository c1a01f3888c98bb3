"""Schemas of the records that the readers give."""

LABEL_FILE = "file_name STRING, image_width INT, image_height INT, annotations ARRAY<STRUCT<label: STRING, text: STRING, box: ARRAY<DOUBLE>>>"
METADATA = (
    "id INT, file_name STRING, template STRING, store_name STRING, total_amount BIGINT, image_path STRING, label_path STRING, pdf_path STRING, is_a4 BOOLEAN, is_c45 BOOLEAN, "
    "augmentations STRUCT<perspective: DOUBLE, shadow: DOUBLE, flash: DOUBLE, fold: DOUBLE, fade: DOUBLE, streak: DOUBLE, background: STRING>"
)
_RESULT = (
    "ARRAY<STRUCT<id: STRING, from_name: STRING, to_name: STRING, type: STRING, score: DOUBLE, "
    "value: STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE, rotation: DOUBLE, rectanglelabels: ARRAY<STRING>, text: ARRAY<STRING>>>>"
)
ANNOTATION_TASK = f"id BIGINT, data STRUCT<image: STRING>, annotations ARRAY<STRUCT<result: {_RESULT}>>, predictions ARRAY<STRUCT<result: {_RESULT}>>"
OCR_LINE = "path STRING, line_no INT, poly ARRAY<ARRAY<DOUBLE>>, text STRING, conf DOUBLE"
INVOICE = (
    "store_name STRING, store_type STRING, address STRING, phone STRING, tax_code STRING, date STRING, invoice_no STRING, cashier STRING, "
    "items ARRAY<STRUCT<no: INT, name: STRING, qty: INT, unit: STRING, price: BIGINT, amount: BIGINT>>, subtotal BIGINT, table_no STRING, discount_rate INT, discount_amount BIGINT, "
    "vat_rate INT, vat_amount BIGINT, total_amount BIGINT, payment_method STRING, cash_received BIGINT, cash_returned BIGINT, total_words STRING"
)
TRAIN_ROW = "id BIGINT, words ARRAY<STRING>, bboxes ARRAY<ARRAY<BIGINT>>, ner_tags ARRAY<INT>"
MODEL_ANSWER = "MAP<STRING, STRUCT<text: STRING, box_2d: ARRAY<INT>>>"
EXTRACTION = "doc_id BIGINT, field STRING, value STRING"
