"""Acceptance checks as aggregations: each gives rows (check_name, ok, measured)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretally.functions import clock, rules, text as X
from wiretally.operators.labelling import rows_in_attack_windows
from wiretally.operators.membership import overlaps
from wiretally.schema import (BEHAVIOURAL_FAMILIES, CONTENT_FAMILIES, CONTEXT_FAMILIES,
                              UNIFIED_FIELDS)
from wiretally.session import tabled

WINDOW_SECONDS = 10


def _unpivot(one_row: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("check_name"), ok.alias("ok"), m.cast("double").alias("measured"))
                      for n, (ok, m) in checks.items()])
    return one_row.select(F.explode(items).alias("c")).select("c.*")


def missing_fields(df: DataFrame) -> list[str]:
    return [c for c in UNIFIED_FIELDS if c not in df.columns]


def row_checks(df: DataFrame, delivery: float = 0.95) -> DataFrame:
    """Null labels and sessions, provenance, injection markers in benign, delivery and volume:
    all in one pass over the table."""
    benign, attack = F.col("label") == "benign", F.col("label") == "attack"
    marked = rules.matches(X.request_text(), rules.INJECTION_MARKERS)
    named = F.instr("label_source", F.col("campaign_id")) > 0
    one = df.agg(
        F.count_if(F.col("label").isNull()).alias("null_label"),
        F.count_if(F.col("label_source").isNull()).alias("null_source"),
        F.count_if(F.col("session_id").isNull() | (F.col("session_id") == "")).alias("no_session"),
        F.count_if(~F.coalesce(named, F.lit(False))).alias("unnamed"),
        F.count_if(benign & marked).alias("marked_benign"),
        F.count_if(attack).alias("attacks"), F.count_if(benign).alias("benigns"),
        F.count_if(attack & F.col("response_status").isNotNull()).alias("delivered"))
    c = F.col
    fraction = F.when(c("attacks") > 0, c("delivered") / c("attacks")).otherwise(F.lit(0.0))
    return _unpivot(one, {
        "zero_null_label": (c("null_label") == 0, c("null_label")),
        "zero_null_label_source": (c("null_source") == 0, c("null_source")),
        "session_id_present": (c("no_session") == 0, c("no_session")),
        "label_source_names_campaign": (c("unnamed") == 0, c("unnamed")),
        "benign_no_injection_markers": (c("marked_benign") == 0, c("marked_benign")),
        "attack_delivery": (fraction >= delivery, fraction),
        "benign_ge_attack": (c("benigns") >= c("attacks"), c("benigns") - c("attacks")),
    })


def benign_purity(df: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Benign rows inside some attack window of their own source. Only their source and time are matched; written first, as the match
    reads them twice."""
    benign = tabled(df.where(F.col("label") == "benign").select("src_ip", "timestamp", "label"), "benign")
    impure = rows_in_attack_windows(benign, campaigns)
    return _unpivot(impure.agg(F.count("*").alias("n")), {"benign_purity": (F.col("n") == 0, F.col("n"))})


def family_volume(df: DataFrame) -> DataFrame:
    """Rows and sorted tools per attack family."""
    return df.where((F.col("label") == "attack") & F.col("attack_family").isNotNull()).groupBy("attack_family").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("attack_tool")).alias("tools"))


def session_windows(df: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Distinct (session, window) pairs per attack family."""
    attack = df.where((F.col("label") == "attack") & F.col("attack_family").isNotNull())
    w = clock.window_number(clock.parse_iso("timestamp"), seconds)
    return attack.select("attack_family", "session_id", w.alias("_w")).distinct().groupBy("attack_family").agg(
        F.count("*").alias("windows"))


def family_checks(df: DataFrame, min_rows: int = 500, min_tools: int = 2, min_windows: int = 50) -> DataFrame:
    """Content families: rows and tools; behavioural: session windows; context: present at all."""
    volume, c = family_volume(df), F.col
    content = volume.where(c("attack_family").isin(CONTENT_FAMILIES)).select(
        F.concat(F.lit("content_"), "attack_family").alias("check_name"),
        ((F.size("tools") >= min_tools) & (c("n") >= min_rows)).alias("ok"), c("n").cast("double").alias("measured"))
    behavioural = session_windows(df).where(c("attack_family").isin(BEHAVIOURAL_FAMILIES)).select(
        F.concat(F.lit("behavioural_"), "attack_family").alias("check_name"),
        (c("windows") >= min_windows).alias("ok"), c("windows").cast("double").alias("measured"))
    counts = df.where(c("label") == "attack").agg(*[
        F.count_if(c("attack_family") == f).alias(f) for f in CONTEXT_FAMILIES])
    context = _unpivot(counts, {f"context_{f}": (c(f) > 0, c(f)) for f in CONTEXT_FAMILIES})
    return content.unionByName(behavioural).unionByName(context)


def split_disjoint(df: DataFrame, session: str = "session_id", split: str = "split") -> DataFrame:
    n = overlaps(df, session, split).agg(F.count("*").alias("n"))
    return _unpivot(n, {"session_split_disjoint": (F.col("n") == 0, F.col("n"))})


def expected_counts(df: DataFrame, expected: DataFrame, dataset: str = "source_id") -> DataFrame:
    """Row and benign counts per dataset against a table (dataset, rows, benign)."""
    have = df.groupBy(dataset).agg(F.count("*").alias("_rows"), F.count_if(F.col("label") == "benign").alias("_benign"))
    both = expected.join(have, dataset, "full_outer")
    ok = F.col("rows").eqNullSafe(F.col("_rows")) & F.col("benign").eqNullSafe(F.col("_benign"))
    return both.select(dataset, ok.alias("ok"), F.col("_rows").alias("rows_found"), F.col("_benign").alias("benign_found"))


def metric_differences(expected: DataFrame, got: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Paths of two long metric tables (path, value, str) that differ: absent on one side,
    numbers further apart than the tolerance, or other values unequal."""
    e = expected.select("path", F.col("value").alias("_ev"), F.col("str").alias("_es"), F.lit(True).alias("_e"))
    g = got.select("path", F.col("value").alias("_gv"), F.col("str").alias("_gs"), F.lit(True).alias("_g"))
    both = e.join(g, "path", "full_outer")
    numeric = F.col("_ev").isNotNull() & F.col("_gv").isNotNull()
    kind = (F.when(F.col("_g").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
            .when(numeric & (F.abs(F.col("_ev") - F.col("_gv")) <= tolerance), F.lit(None))
            .when(numeric, "value")
            .when(F.col("_ev").eqNullSafe(F.col("_gv")) & F.col("_es").eqNullSafe(F.col("_gs")), F.lit(None))
            .otherwise("value"))
    return both.select("path", kind.alias("difference"), F.col("_ev").alias("expected"), F.col("_gv").alias("got")).where(
        F.col("difference").isNotNull())


def decode_mismatches(rebuilt: DataFrame, reference: DataFrame, index: str = "row_index") -> DataFrame:
    """Rows whose decoded text differs from the frozen table, by row index."""
    ref = reference.select(index, F.col("dec").alias("_want"))
    return rebuilt.withColumn("_have", X.decode(X.request_text())).join(ref, index, "full_outer").where(
        ~F.col("_have").eqNullSafe(F.col("_want"))).select(index)


def covered_features(campaigns: DataFrame, app: str = "crapi") -> DataFrame:
    """Union of the feature lists of the benign campaigns of an application."""
    return (campaigns.where((F.col("label") == "benign") & (F.col("app") == app))
            .select(F.explode("extra.feature_coverage").alias("feature")).distinct().orderBy("feature"))
