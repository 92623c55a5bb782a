"""Row ids, session ids and provenance strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretally.functions import text as X

# Id namespaces of the access-log and honeypot ingests.
ACCESS_LOG_NAMESPACE = "6f1a7b2c-0000-4000-8000-000000000a00"
HONEYPOT_NAMESPACE = "6f1a7b2c-0000-4000-8000-000000000db0"
API_APPS = ("vampi", "crapi")


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(
        F.conv(F.substring(digest, 17, 1), 16, 10).cast("bigint").bitwiseAND(F.lit(3))
        .bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def token_payload(authorization: Column) -> Column:
    """Claims of an unverified three-part bearer token as JSON text; null if unreadable."""
    body = F.regexp_extract(authorization, r"(?i)^bearer\s+[^.]*\.([^.]*)\.[^.]*$", 1)
    padded = F.rpad(F.translate(body, "-_", "+/"), ((F.length(body) + 3) / 4).cast("int") * 4, "=")
    return F.try_validate_utf8(F.try_to_binary(F.nullif(padded, F.lit("")), F.lit("base64")).cast("string"))


def token_subject(payload: Column) -> Column:
    """``sub`` of the claims, or the user name nested in it."""
    sub = F.get_json_object(payload, "$.sub")
    nested = F.coalesce(F.nullif(F.get_json_object(payload, "$.sub.username"), F.lit("")),
                        F.get_json_object(payload, "$.sub.user"))
    return F.when(F.startswith(sub, F.lit("{")), nested).otherwise(sub)


def with_session_id(df: DataFrame, app: str = "app", src_ip: str = "src_ip") -> DataFrame:
    """Add ``session_id``: API applications group by authenticated user, everything else (and
    requests without a readable token) by source address."""
    staged = df.withColumn("_auth", X.header("headers", "authorization")).withColumn(
        "_sub", token_payload(F.col("_auth"))).withColumn("_sub", token_subject(F.col("_sub")))
    by_ip = F.concat(app, F.lit(":ip:"), F.coalesce(src_ip, F.lit("")))
    by_user = F.concat(app, F.lit(":user:"), "_sub")
    has_user = F.col(app).isin(*API_APPS) & (F.col("_sub") != "")
    return staged.withColumn("session_id", F.when(has_user, by_user).otherwise(by_ip)).drop("_auth", "_sub")


def provenance(campaign_id: Column, tool: Column, src_ip: Column, start: Column, end: Column) -> Column:
    """Which campaign, tool, source and window put a label on a row."""
    return F.concat(
        F.lit("campaign="), campaign_id, F.lit(" tool="), F.coalesce(tool, F.lit("None")),
        F.lit(" src="), src_ip, F.lit(" window=["), start, F.lit(","), end, F.lit(")"))
