"""CSV exports, captures, manifests, unified Parquet and the source registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wiretally.functions import clock, identity, text as X
from wiretally.operators.dedup import first_per_key, keep_first
from wiretally.operators.ranking import seeded_sample
from wiretally.schema import CAPTURE_SCHEMA, MANIFEST_SCHEMA, UNIFIED_SCHEMA, conform, model_input, tag_source
from wiretally.session import tabled
from wiretally.sources.lines import number_rows, with_target

# Columns of the honeypot export and how its header columns are called on the wire.
NORMAL_COLUMN = "000 - Normal"
HONEYPOT_HEADERS = ["request_user_agent", "request_referer", "request_host", "request_origin", "request_cookie",
                    "request_content_type", "request_accept", "request_accept_language", "request_accept_encoding",
                    "request_do_not_track", "request_connection"]
HONEYPOT_COLUMNS = ["timestamp", "src_ip", "src_port", "request_http_method", "request_http_request",
                    "request_http_protocol", "request_body", "response_http_status_code", "response_content_length",
                    NORMAL_COLUMN] + HONEYPOT_HEADERS
HONEYPOT_SOURCE = ("external=SR-BH 2020 honeypot; binary label from '000 - Normal'; CAPEC classes not used as family")


def _csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a CSV export as text, absent values as ``""``, with row numbers."""
    raw = number_rows(spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False))
    present = set(raw.columns)
    return raw.select("row_id", "line_no", *[
        F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in present else F.lit(None).cast("string").alias(c)
        for c in columns])


def honeypot_csv(spark: SparkSession, path: str) -> DataFrame:
    """Honeypot export as unified rows (plus ``row_id``): binary label, headers folded into JSON."""
    rows = with_target(_csv(spark, path, HONEYPOT_COLUMNS), F.col("request_http_request"))
    wire = {c: c.replace("request_", "").replace("_", "-") for c in HONEYPOT_HEADERS}
    seq = F.concat(F.lit("srbh:"), F.col("row_id").cast("string"))
    rows = rows.withColumns({
        "capture_id": identity.uuid5(identity.HONEYPOT_NAMESPACE, seq), "timestamp": clock.clf_utc_iso(F.col("timestamp")),
        "src_port": clock.integer_or(F.col("src_port"), 0), "http_method": F.col("request_http_method"),
        "url_path": X.percent_decode(F.col("url_path_raw"), plus_is_space=False),
        "http_version": F.col("request_http_protocol"), "host": F.col("request_host"),
        "headers": X.headers_json_nonempty(wire), "response_status": clock.integer_or(F.col("response_http_status_code")),
        "response_size": clock.integer_or(F.col("response_content_length"), 0), "app": F.lit("srbh"),
        "session_id": F.concat(F.lit("srbh:ip:"), "src_ip"),
        "label": F.when(F.col(f"`{NORMAL_COLUMN}`") == "1", "benign").otherwise("attack"),
        "campaign_id": F.lit("srbh_external"), "label_source": F.lit(HONEYPOT_SOURCE)})
    return conform(rows, UNIFIED_SCHEMA, "row_id")


def semi_synthetic_csv(spark: SparkSession, path: str) -> DataFrame:
    """Method, URL (with a trailing protocol), agent, content and an integer class."""
    rows = _csv(spark, path, ["Method", "URL", "User-Agent", "content", "classification"])
    url = F.split_part("URL", F.lit(" "), F.lit(1))
    # the target after scheme and authority; a bare path is taken as it is
    target = F.when(url.startswith("http"), F.regexp_replace(url, "^[a-z]+:/*[^/?#]*", "")).otherwise(
        F.concat(F.lit("/"), F.ltrim(url, F.lit("/"))))
    rows = with_target(rows, F.regexp_replace(target, "#.*$", ""))
    rows = rows.select(
        "row_id", F.col("Method").alias("http_method"), "url_path_raw", "url_query",
        F.coalesce("content", F.lit("")).alias("request_body"),
        F.to_json(F.create_map(F.lit("User-Agent"), F.coalesce("User-Agent", F.lit("")))).alias("headers"),
        F.when(F.col("classification") == "0", "benign").otherwise("attack").alias("label"))
    return tag_source(keep_first(rows), "csic", "semi-synthetic", True)


def filing_csv(spark: SparkSession, path: str | Sequence[str], rows_per_file: int | None = None,
               cap: int | None = None) -> DataFrame:
    """Filing-server export: the document address rebuilt from its parts, unique by method and path."""
    raw = number_rows(spark.read.csv(path, header=True, inferSchema=False))
    if rows_per_file:
        raw = raw.where(F.col("line_no") <= rows_per_file)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cik = F.coalesce(text("cik").try_cast("double").try_cast("bigint"), F.lit(0)).cast("string")
    rows = raw.select(
        "row_id", clock.date_time_iso(text("date"), text("time")).alias("timestamp"), F.lit("GET").alias("http_method"),
        F.concat(F.lit("/Archives/edgar/data/"), cik, F.lit("/"), text("accession"), text("extention")).alias("url_path_raw"),
        *[F.lit("").alias(c) for c in ("url_query", "request_body", "headers")], F.lit("benign").alias("label"))
    unique = first_per_key(rows, [X.signature_key(["http_method", "url_path_raw"])])
    return seeded_sample(unique, cap, X.signature(["http_method", "url_path_raw"])) if cap else unique


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Campaign manifests with ``ord``, the file name that decides which one matches first."""
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return raw.withColumn("ord", F.col("_metadata.file_name"))


def capture_lines(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Capture lines and, beside them, the rejected ones: (file, reason, line). A line is rejected if it is no JSON object of the expected
    types (torn lines) or has no readable timestamp; blank lines are neither. The lines are parsed once and written, so that both
    tables, and any count of them, come from the same pass."""
    schema = T.StructType([*CAPTURE_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    torn, undated = F.col("_corrupt_record").isNotNull(), clock.parse_iso("timestamp").isNull()
    reason = F.when(torn, "torn").when(undated, "no timestamp")
    line = F.coalesce("_corrupt_record", F.to_json(F.struct(*CAPTURE_SCHEMA.names)))
    read = tabled(number_rows(raw).select("*", reason.alias("reason"), F.when(reason.isNotNull(), line).alias("line")), "captures")
    good = read.where("reason IS NULL").drop("_corrupt_record", "reason", "line")
    return good, read.where("reason IS NOT NULL").select("file", "reason", "line")


def captures(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The readable capture lines, numbered; see ``capture_lines`` for those that are not."""
    return capture_lines(spark, path)[0]


def unified(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Unified Parquet; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def model_source(df: DataFrame, source_id: str, nature: str, has_body: bool, *keep: str) -> DataFrame:
    """Unique model-input rows of a source with its metadata. ``df`` has ``row_id``."""
    return tag_source(keep_first(model_input(df, "row_id", *keep)), source_id, nature, has_body)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed rows: ``row_index``, method, decoded text and labels."""
    schema = T.StructType([T.StructField("row_index", T.LongType())] + [
        T.StructField(c, T.StringType()) for c in ("http_method", "dec", "family_label", "pred_family")])
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def gather(loaders: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All sources that can be read, under one schema; a missing one is skipped."""
    out = None
    for load in loaders.values():
        try:
            df = load()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source could be read")
    return out
