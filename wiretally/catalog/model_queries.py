"""Model jobs over the given tables. Iterative fits have no SQL twin; their parts, and what holds at their end, do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wiretally.catalog.registry import query
from wiretally.catalog.text_queries import SQL_SIG, sql_shape, sql_unit
from wiretally.functions import shape, text as X
from wiretally.operators import dedup, membership, metrics, splits
from wiretally.plans import boosting, detector as D, jobs
from wiretally.session import settle
from wiretally.sources.sinks import metrics_frame

QUICK = D.Settings(text_iterations=15, boosting_rounds=3, boosting_leaves=8, boosting_bins=32)


def _pools(t) -> DataFrame:
    """Every second attack as the main source, the others as the source with a held-out tool. Requests that are held out
    leave training wherever they occur."""
    attacks = t.flows.where(F.col("label") == "attack")
    main = dedup.keep_first(attacks.where(F.col("row_id") % 2 == 0)).withColumn("source_id", F.lit("main"))
    other = attacks.where(F.col("row_id") % 2 == 1).withColumn("source_id", F.lit("testbed"))
    pools = settle(splits.attack_pools(main, other))
    held = pools.where("role <> 'train'")
    return settle(membership.exclude_seen(pools.where("role = 'train'"), held).unionByName(held))


def _benign(t) -> DataFrame:
    return t.flows.where(F.col("label") == "benign")


@query("M1 M2 M6 M7")
def domain_evaluation(t):
    """Text model on early benign flows, rates on late ones and on held-out attacks."""
    return metrics_frame(t.spark, jobs.domain(_benign(t), _pools(t), settings=QUICK)[0])


@query("M3 M4 M5 M7 A16 A17")
def detector_scores(t):
    """Both channels and their fusion on held-out sessions, as ranking quality per channel."""
    rows = dedup.keep_first(t.flows).withColumn("y", (F.col("label") == "attack").cast("int"))
    cut = splits.session_split(rows, "src_ip")
    model = D.fit_detector(cut.where("split = 'train'"), cut.where("split = 'calib'"), QUICK)
    scored = model.score(cut.where("split = 'test'")).persist()
    out = None
    for channel in jobs.ALL_CHANNELS:
        part = metrics.ranking_quality(scored, channel, F.col("y") == 1).withColumn("channel", F.lit(channel))
        out = part if out is None else out.unionByName(part)
    return out


GROWTH = boosting.Growth()

SQL_FIRST_SPLITS = f"""
    WITH numbers AS ({sql_shape()}),
      n AS (SELECT numbers.*, CAST(label = 'attack' AS INT) AS y FROM numbers JOIN v_flows USING (row_id)),
      v AS (SELECT y, unnest([{', '.join(f"'{c}'" for c in shape.FEATURE_NAMES)}]) AS feature, unnest([{', '.join(shape.FEATURE_NAMES)}]) AS v FROM n),
      d AS (SELECT *, sum(c) OVER (PARTITION BY feature ORDER BY v) AS upto, lead(v) OVER (PARTITION BY feature ORDER BY v) AS next,
          count(*) OVER (PARTITION BY feature) AS many, sum(c) OVER (PARTITION BY feature) AS n, sum(pos) OVER (PARTITION BY feature ORDER BY v) AS pos_upto
        FROM (SELECT feature, v, count(*) AS c, sum(y) AS pos FROM v GROUP BY 1, 2)),
      ranks AS (SELECT CAST(k AS DOUBLE) / {GROWTH.bins} AS q FROM range(1, {GROWTH.bins}) t(k)),
      cuts AS (SELECT feature, v, v / 2 + next / 2 AS cut FROM d WHERE many <= {GROWTH.bins} AND next IS NOT NULL
        UNION SELECT feature, min(v), min(v) FROM d, ranks WHERE many > {GROWTH.bins} AND upto >= ceil(q * n) GROUP BY feature, q),
      s AS (SELECT feature, cut, upto AS l, pos_upto AS pl, n, (SELECT sum(y) FROM n) AS pos FROM cuts JOIN d USING (feature, v)),
      g AS (SELECT *, pos / n AS p, l * (pos / n) - pl AS gl, (n - l) * (pos / n) - (pos - pl) AS gr, l * (pos / n) * (1 - pos / n) AS hl, (n - l) * (pos / n) * (1 - pos / n) AS hr FROM s),
      w AS (SELECT *, gl * gl / (hl + {GROWTH.l2}) + gr * gr / (hr + {GROWTH.l2}) - (gl + gr) * (gl + gr) / (hl + hr + {GROWTH.l2}) AS gain FROM g
        WHERE least(l, n - l) >= {GROWTH.least_rows} AND least(hl, hr) >= {boosting.LEAST_HESSIAN})
    SELECT feature, round(cut, 6) AS cut, round(gain / n, 5) AS mean_gain, CAST(l AS BIGINT) AS rows_left FROM w WHERE gain > 0
    QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, cut) = 1"""


@query("M3 P20", SQL_FIRST_SPLITS)
def first_splits(t):
    """The best root split of every numeric feature over all flows, with production parameters."""
    f = shape.with_shape_features(t.flows.withColumn("y", (F.col("label") == "attack").cast("int")))
    rows = settle(f.select("y", *[F.round(c, 6).alias(c) for c in shape.FEATURE_NAMES]))
    best = boosting.first_splits(rows, shape.FEATURE_NAMES, "y", GROWTH)
    return best.select("feature", F.round("cut", 6).alias("cut"), F.round(F.col("gain") / rows.count(), 5).alias("mean_gain"), "rows_left")


CALIBRATED = """
    WITH u AS (SELECT *, {unit} AS unit FROM v_flows QUALIFY row_number() OVER (PARTITION BY {sig} ORDER BY row_id) = 1),
      c AS (SELECT label FROM u WHERE unit >= 0.6 AND unit < 0.8)
    SELECT channel, budget, count(*) AS n, count(*) FILTER (label = 'attack') AS attacks, count(*) FILTER (label = 'attack') / count(*) AS mean_label,
      TRUE AS balanced, TRUE AS within_budget
    FROM c, (VALUES ('p_text'), ('p_numeric'), ('p_content')) x(channel), (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) y(budget) GROUP BY 1, 2"""


@query("M2 M3 M4 M5 M6 M7", CALIBRATED.format(unit=sql_unit("src_ip"), sig=SQL_SIG))
def calibrated_detector(t):
    """What must hold for a fitted detector on its calibration rows: the fused probabilities add up to the labels, and no channel
    alerts on more benign rows than its budget allows."""
    rows = dedup.keep_first(t.flows).withColumn("y", (F.col("label") == "attack").cast("int"))
    cut = settle(splits.session_split(rows, "src_ip"))
    calib = cut.where("split = 'calib'")
    model = D.fit_detector(cut.where("split = 'train'"), calib, QUICK)
    scored = settle(model.score(calib).select("y", *jobs.ALL_CHANNELS))
    out = None
    for channel in jobs.ALL_CHANNELS:
        for budget in D.BUDGETS:
            over = F.count_if((F.col("y") == 0) & (F.col(channel) > model.threshold(channel, budget)))
            part = scored.agg(
                F.lit(channel).alias("channel"), F.lit(budget).alias("budget"), F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("attacks"),
                F.avg("y").alias("mean_label"), (F.abs(F.avg("p_content") - F.avg("y")) < 1e-4).alias("balanced"),
                (over <= budget * F.count_if(F.col("y") == 0)).alias("within_budget"))
            out = part if out is None else out.unionByName(part)
    return out


@query("M9 A19")
def family_head(t):
    """Family head trained on two tools, confusion table on the third."""
    attacks = dedup.keep_first(t.flows.where(F.col("label") == "attack"))
    head = D.fit_family(attacks.where(F.col("attack_tool") != "custom"), QUICK)
    return metrics.confusion(head.predict(attacks.where(F.col("attack_tool") == "custom")), "attack_family", "pred_family")


@query("W9 M10 M11 V0 V2 V9")
def mutation_robustness(t):
    """Recall of model, probe and rules under every payload rewrite."""
    train = t.flows.where(~F.coalesce((F.col("label") == "attack") & (F.col("attack_tool") == "custom"), F.lit(False)))
    train = train.withColumn("y", (F.col("label") == "attack").cast("int"))  # without the tool that is held out
    cut = splits.session_split(dedup.keep_first(train), "src_ip")
    model = D.fit_text(cut.where("split = 'train'"), QUICK)
    threshold = D.text_thresholds(model, cut.where("split = 'calib' AND y = 0"))[D.PRIMARY]
    return metrics_frame(t.spark, jobs.mutation_robustness(model, threshold, dedup.keep_first(t.flows), QUICK))
