"""The unified request table (one row per HTTP transaction) and its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_LONG_FIELDS = {"src_port", "response_status", "response_size"}
_DOUBLE_FIELDS = {"response_time_ms"}

# Column names and order of the capture and provenance halves of the table.
CAPTURE_FIELDS = [
    "capture_id", "timestamp", "src_ip", "src_port", "http_method", "url_path", "url_path_raw",
    "url_query", "http_version", "host", "headers", "request_body", "request_content_type",
    "response_status", "response_size", "response_time_ms", "app",
]
PROVENANCE_FIELDS = [
    "session_id", "label", "attack_family", "attack_tool", "campaign_id", "label_source",
]
UNIFIED_FIELDS = CAPTURE_FIELDS + PROVENANCE_FIELDS

# Controlled vocabularies.
CONTENT_FAMILIES = [
    "sqli", "xss", "cmd_injection", "nosql_injection", "ldap_injection", "ssti",
    "path_traversal", "ssrf", "scan",
]
BEHAVIOURAL_FAMILIES = ["brute_force", "cred_stuffing", "resource_exhaustion"]
CONTEXT_FAMILIES = ["bola_idor", "mass_assignment", "business_logic_abuse"]
ATTACK_FAMILIES = CONTENT_FAMILIES + BEHAVIOURAL_FAMILIES + CONTEXT_FAMILIES
ATTACK_TOOLS = ["sqlmap", "zap", "nuclei", "ffuf", "wfuzz", "hydra", "patator", "custom"]
APPS = ["crapi", "vampi", "zanbil", "srbh"]

# What the detector reads, and the four columns that identify a request.
MODEL_FIELDS = ["http_method", "url_path_raw", "url_query", "request_body", "headers", "label"]
SIGNATURE_FIELDS = ["http_method", "url_path_raw", "url_query", "request_body"]


def _field(name: str) -> T.StructField:
    if name in _LONG_FIELDS:
        return T.StructField(name, T.LongType())
    if name in _DOUBLE_FIELDS:
        return T.StructField(name, T.DoubleType())
    return T.StructField(name, T.StringType())


UNIFIED_SCHEMA = T.StructType([_field(c) for c in UNIFIED_FIELDS])
CAPTURE_SCHEMA = T.StructType([_field(c) for c in CAPTURE_FIELDS])

MANIFEST_SCHEMA = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("campaign_id", "app", "label", "attack_family", "attack_tool", "src_ip",
              "start_ts", "end_ts")
] + [T.StructField("extra", T.StructType([
    T.StructField("feature_coverage", T.ArrayType(T.StringType())),
]))])


def conform(df: DataFrame, schema: T.StructType = UNIFIED_SCHEMA, *keep: str) -> DataFrame:
    """Project onto ``schema`` in order, casting and adding absent columns as nulls; ``keep`` goes
    in front."""
    present = set(df.columns)
    return df.select(*keep, *[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def model_input(df: DataFrame, *keep: str) -> DataFrame:
    """The columns the detector reads: absent ones become ``""`` and a null body becomes ``""``."""
    present = set(df.columns)
    cols = [(F.col(c) if c in present else F.lit("")).alias(c) for c in MODEL_FIELDS]
    body = MODEL_FIELDS.index("request_body")
    cols[body] = F.coalesce(cols[body], F.lit("")).alias("request_body")
    return df.select(*keep, *cols)


def tag_source(df: DataFrame, source_id: str, nature: str, has_body: bool) -> DataFrame:
    """Attach the source metadata carried beside every request."""
    return df.withColumns({
        "source_id": F.lit(source_id), "nature": F.lit(nature), "has_body": F.lit(has_body),
    })
