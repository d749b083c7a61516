"""Schemas of the tables, and fixed value sets."""

#: Categories, classifications, rule kinds.
CATEGORIES = ("MEMORY_LEAK", "DOUBLE_FREE", "USE_AFTER_FREE", "UNINIT_USE", "BUFFER_OVERFLOW")
CLASSIFICATIONS = ("TP", "FP", "UNCERTAIN")
RULE_KINDS = ("initializer", "memory_transfer", "allocator", "deallocator", "resource_open", "resource_close", "ownership_transfer", "heap_object_summary", "domain_hint")
RULE_STATES = ("proposed", "approved", "rejected")
MATCHES = ("exact", "substring")
#: Roles of path nodes by preference as primary location.
PRIMARY_ROLES = ("use", "second_free", "free", "first_free", "allocation", "object_origin")

#: Lines and columns as they are spelled; they are converted where a location is taken.
LOC = "STRUCT<file: STRING, line: STRING, column: STRING>"
NODE = f"STRUCT<role: STRING, location: {LOC}>"
ALERT = (
    f"alert_id STRING, category STRING, path ARRAY<{NODE}>, allocation {NODE}, paths ARRAY<STRUCT<path: ARRAY<{NODE}>>>, leak_condition STRING, "
    f"access STRUCT<kind: STRING, location: {LOC}>, evidence STRUCT<memory_object: STRUCT<type: STRING, descriptor: STRING>>, "
    "range_analysis STRING, classification STRING, reason STRING"
)
CANDIDATE = "STRUCT<kind: STRING, function: STRING, match: STRING, effect: STRING, target_arg: STRING, source_arg: STRING, length_arg: STRING, field_path: STRING, pair: STRING, confidence: STRING, reason: STRING>"
CALL = f"STRUCT<alert_ids: ARRAY<STRING>, classification: STRING, reason: STRING, semantic_candidates: ARRAY<{CANDIDATE}>>"
RULE = (
    "STRUCT<id: STRING, status: STRING, kind: STRING, function: STRING, match: STRING, source_alert_id: STRING, proposed_by: STRING, effect: STRING, "
    "target_arg: INT, source_arg: INT, length_arg: INT, field_path: STRING, pair: STRING, confidence: DOUBLE, reason: STRING>"
)
