"""Rates, curves and confusion tables over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wiretally.session import settle

SPLITS = 256


def share(condition: Column) -> Column:
    """Mean of a condition as a double (null for no rows)."""
    return F.avg(condition.cast("double"))


def alert_rates(scored: DataFrame, thresholds: Sequence[tuple[str, float, float]], by: Sequence[str] = ("evaluation_set",)
                ) -> DataFrame:
    """Alert rate of every evaluation set for every (score column, budget, threshold), in one
    pass over the scores."""
    cases = F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.lit(float(a)).alias("budget"), (F.col(c) >= F.lit(float(t))).alias("hit"))
        for c, a, t in thresholds]))
    each = scored.select(*by, cases.alias("_c"))
    return each.groupBy(*by, F.col("_c.channel").alias("channel"), F.col("_c.budget").alias("budget")).agg(
        F.count("*").alias("n"), share(F.col("_c.hit")).alias("alert_rate"))


def recall_by_marker(df: DataFrame, ml_hit: Column, rule_hit: Column) -> DataFrame:
    """Recall of the learned detector and of the rules: overall, where a rule fires, elsewhere."""
    staged = df.select(ml_hit.alias("_ml"), rule_hit.alias("_rule"))
    counts = staged.rollup("_rule").agg(
        F.count("*").alias("n"), share(F.col("_ml")).alias("ml_recall"), share(F.col("_rule")).alias("rule_recall"),
        F.grouping("_rule").alias("_all"))
    part = F.when(F.col("_all") == 1, "overall").when(F.col("_rule"), "marked").otherwise("marker_free")
    return counts.select(part.alias("part"), "n", "ml_recall", "rule_recall")


def _ranked(df: DataFrame, score: str, y: Column) -> tuple[DataFrame, int, int]:
    """One row per distinct score with the class counts at it and below it, and both totals.
    Scores are cut into about equally filled cells; what lies in lower cells is added as a number,
    so the running sums never pass through one task."""
    at = settle(df.groupBy(F.col(score).alias("_s")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))
    grid = [i / SPLITS for i in range(1, SPLITS)]
    splits = at.agg(F.percentile_approx("_s", grid)).first()[0] or []
    cell = F.size(F.filter(F.array(*map(F.lit, sorted(set(splits)))), lambda x: x < F.col("_s"))) if splits else F.lit(0)
    placed = at.withColumn("_cell", cell)
    cells = placed.groupBy("_cell").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()
    ahead, p, n = {}, 0, 0
    for row in sorted(cells, key=lambda r: r["_cell"]):  # at most SPLITS rows
        ahead[row["_cell"]] = (p, n)
        p, n = p + row.p, n + row.n
    offset = lambda i: F.element_at(F.array(*[
        F.lit(ahead.get(c, (0, 0))[i]).cast("bigint") for c in range(SPLITS)]), F.col("_cell") + 1)
    within = W.partitionBy("_cell").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        "_s", "pos", "neg", (offset(0) + F.coalesce(F.sum("pos").over(within), F.lit(0))).alias("pos_below"),
        (offset(1) + F.coalesce(F.sum("neg").over(within), F.lit(0))).alias("neg_below")), p, n


def ranking_quality(df: DataFrame, score: str, y: Column) -> DataFrame:
    """ROC AUC (ties count half) and step-wise average precision; null when a class is absent."""
    ranked, positives, negatives = _ranked(df, score, y)
    d = {c: F.col(c).cast("double") for c in ("pos", "neg", "pos_below", "neg_below")}
    hits, false = float(positives) - d["pos_below"], float(negatives) - d["neg_below"]
    both = positives > 0 and negatives > 0
    sums = ranked.agg(F.sum(d["pos"] * (d["neg_below"] + d["neg"] / 2)).alias("area"),
                      F.sum(d["pos"] * hits / (hits + false)).alias("ap"))
    value = lambda c: c if both else F.lit(None).cast("double")
    return sums.select(
        F.lit(positives).cast("bigint").alias("positives"), F.lit(negatives).cast("bigint").alias("negatives"),
        value(F.col("area") / (float(positives) * float(negatives) or 1.0)).alias("roc_auc"),
        value(F.col("ap") / float(positives or 1)).alias("pr_auc"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def threshold_metrics(df: DataFrame, score: str, y: Column, threshold: float | Column,
                      by: Sequence[str] = ()) -> DataFrame:
    """F1, precision, recall and false-positive rate at a threshold; a zero division gives 0."""
    counted = df.select(*by, (F.col(score) >= threshold).alias("_hit"), y.alias("_y")).groupBy(*by).agg(
        F.count_if(F.col("_hit") & F.col("_y")).alias("tp"), F.count_if(F.col("_hit") & ~F.col("_y")).alias("fp"),
        F.count_if(~F.col("_hit") & F.col("_y")).alias("fn"), F.count_if(~F.col("_hit") & ~F.col("_y")).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counted.select(*by, "tp", "fp", "fn", "tn", _ratio(tp, tp + fp).alias("precision"),
                          _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                          _ratio(fp, fp + tn).alias("fpr"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, predicted: str, empty: float | None = 0.0) -> DataFrame:
    """Support, precision and recall per class of either column; ``empty`` stands for 0/0."""
    cells = confusion(df, truth, predicted)
    sides = F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.lit(True).alias("is_truth")),
        F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_truth"))))
    long = cells.select("truth", "predicted", "n", sides.alias("s"))
    per = long.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.when(F.col("s.is_truth"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("s.is_truth"), F.col("n")).otherwise(0)).alias("_predicted"),
        F.sum(F.when(F.col("s.is_truth") & (F.col("truth") == F.col("predicted")), F.col("n")).otherwise(0)).alias("_tp"))
    zero = F.lit(empty).cast("double")
    return per.select("label", "support",
                      F.when(F.col("_predicted") > 0, F.col("_tp") / F.col("_predicted")).otherwise(zero).alias("precision"),
                      F.when(F.col("support") > 0, F.col("_tp") / F.col("support")).otherwise(zero).alias("recall"))


def annotator_agreement(df: DataFrame, hits: Column, label: Column) -> DataFrame:
    """How often the label is among the firing rules, over rows where any rule fires."""
    staged = df.select(hits.alias("_h"), label.alias("_l")).where(F.size("_h") > 0)
    return staged.agg(F.count("*").alias("n_fired"), share(F.array_contains("_h", F.col("_l"))).alias("agreement"))


def macro_mean(per_group: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return per_group.groupBy(*by).agg(F.avg(value).alias(value), F.sum("n").alias("n"))


def site_attribution(scored: DataFrame, train_sites: DataFrame, first_seen: DataFrame,
                     boundary: Column, site: str = "site", alert: str = "alert") -> DataFrame:
    """Rows, alerts and rate per site, whether training saw it and whether it came up later."""
    per = scored.groupBy(site).agg(
        F.count("*").alias("n_test"), F.count_if(F.col(alert)).alias("alerts")).withColumn(
        "alert_rate", F.col("alerts") / F.col("n_test"))
    known = train_sites.select(site).distinct().withColumn("in_train", F.lit(True))
    return (per.join(known, site, "left").join(first_seen, site, "left")
            .withColumn("in_train", F.coalesce("in_train", F.lit(False)))
            .withColumn("appeared_after_split", F.col("first_seen") >= boundary))


def top_sites(per_site: DataFrame, n: int = 15, site: str = "site") -> DataFrame:
    """The sites with the most alerts (a report of at most ``n`` rows)."""
    return per_site.orderBy(F.desc("alerts"), site).limit(n)


def coverage_summary(per_site: DataFrame) -> DataFrame:
    """Rates on covered and uncovered sites and the share of all alerts from uncovered ones."""
    def total(col: str, covered: bool) -> Column:
        keep = F.col("in_train") if covered else ~F.col("in_train")
        return F.sum(F.when(keep, F.col(col)).otherwise(0))

    out = per_site.agg(
        F.count("*").alias("sites"), F.count_if(F.col("in_train")).alias("covered_sites"),
        total("n_test", True).alias("covered_n"), total("alerts", True).alias("covered_alerts"),
        total("n_test", False).alias("uncovered_n"), total("alerts", False).alias("uncovered_alerts"))
    c = F.col
    return out.select(
        "sites", "covered_sites", "covered_n", "uncovered_n",
        F.try_divide(c("covered_alerts"), c("covered_n")).alias("covered_rate"),
        F.try_divide(c("uncovered_alerts"), c("uncovered_n")).alias("uncovered_rate"),
        F.try_divide(c("uncovered_alerts"), c("covered_alerts") + c("uncovered_alerts")).alias("uncovered_share"))


def corrected_rate(rate: Column, reviewed: Column, marked: Column, empty_share: float = 1.0) -> Column:
    """Alert rate times the unmarked share of the reviewed alerts."""
    return rate * F.when(reviewed > 0, (reviewed - marked) / reviewed).otherwise(F.lit(empty_share))
