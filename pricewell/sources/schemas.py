"""Declared schemas of stored tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names.split()]


def _longs(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names.split()]


QUOTE_TEXT = "run_key task_key brand_id brand_title series_id series_title model_id model_title city_id city_title group_title gid sid cid sno sname city_name activation dstatus gprice gprice_two price_text price_image_file"
QUOTES = T.StructType([*_longs("id"), *_strings(QUOTE_TEXT + " clean_scope condition_bucket"), T.StructField("is_target_price", T.IntegerType()), T.StructField("needs_review", T.IntegerType()), *_strings("matched_positive_tags matched_negative_tags matched_sale_tags exclude_reason rule_note imported_at")])
QUOTE_CSV = T.StructType(_strings(QUOTE_TEXT))
TASKS = T.StructType([*_strings("run_key task_key event_time brand_title series_title model_title status code msg error_text"), *_longs("total_rows_seen row_count drop_by_date drop_out_of_stock drop_by_strict_dstatus drop_by_open_dstatus drop_invalid_price"), *_strings("payload_json")])
RUNS = T.StructType(_strings("run_key source_dir started_at finished_at status summary_json created_at"))
EVENTS = T.StructType([*_longs("id"), *_strings("run_key event_key event_time event_type task_key brand_title series_title model_title city_title details_json")])
STATE = T.StructType(_strings("state_key state_value updated_at"))
BLACKLIST = T.StructType(_strings("enabled model_id brand_title series_title model_title reason source_batch note"))
REFERENCE_ROWS = T.StructType([*_longs("import_id"), *_strings("image_name source_title raw_title normalized_title"), *_longs("reference_price"), *_strings("ocr_confidence matched_run_key matched_brand_title matched_series_title matched_model_title matched_group_title matched_condition_bucket"), T.StructField("match_score", T.DoubleType()), *_strings("payload_json imported_at")])
MESSAGES = T.StructType([*_strings("message_id user_id text"), T.StructField("ts", T.TimestampType())])
RESPONSE_ROW = T.StructType(_strings("GID SID CID SNo SName cityName activation dstatus GPrice GPriceTwo Price"))
RESPONSE = T.StructType([*_strings("task_key code msg"), T.StructField("A", T.ArrayType(T.StructType([*_strings("title"), T.StructField("data", T.ArrayType(RESPONSE_ROW))])))])
