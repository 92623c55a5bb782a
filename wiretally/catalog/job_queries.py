"""The named jobs over the given tables, with few iterations. What a fit makes of the numbers has no SQL twin; which rows it was
shown and judged on has one: every job's result is written as metrics and read back, and its counts per set, role, site, rule and family
are held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wiretally.catalog.corpus_queries import SQL_MATCHED
from wiretally.catalog.model_queries import _benign, _pools
from wiretally.catalog.registry import query
from wiretally.catalog.text_queries import SQL_SIG, sql_any_rule, sql_bucket, sql_decode, sql_rule, sql_text, sql_unit
from wiretally.functions import rules, text as X
from wiretally.operators import dedup, membership, metrics, splits
from wiretally.plans import detector as D, jobs
from wiretally.session import scratch_path, settle
from wiretally.sources import sinks, tables

TINY = D.Settings(text_iterations=3, boosting_rounds=1, boosting_leaves=4, boosting_bins=16)
COUNT = r"(^|/)(n|rows/[^/]+)$"


def _counts(t, result: dict, wanted: str = COUNT) -> DataFrame:
    """The counts of a job's result, from its stored metrics."""
    path = scratch_path(t.spark, "metrics")
    sinks.write_metrics(sinks.metrics_frame(t.spark, result), path)
    return t.spark.read.schema(sinks.METRICS).json(path).where(F.col("path").rlike(wanted)).select("path", F.col("value").cast("long").alias("n"))


def _flows(t) -> DataFrame:
    return t.flows.withColumns({"source_id": F.lit("testbed"), "session_id": F.col("src_ip"), "gt_rule": F.col("attack_family")})


def _app(df: DataFrame, app: str) -> DataFrame:
    return df.where(F.col("app") == app)


def _us() -> str:
    return "epoch_us(strptime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ'))"


def _sql_unique(name: str, where: str) -> str:
    """CTE: first row of each request among those rows."""
    return f"{name} AS (SELECT *, {SQL_SIG} AS sig, {_us()} AS us FROM v_flows WHERE {where} QUALIFY row_number() OVER (PARTITION BY {SQL_SIG} ORDER BY row_id) = 1)"


def _sql_cut(name: str) -> str:
    """CTE: rows before and after the time of the 70 % quantile, and by hash, of a CTE of unique rows."""
    return f"""{name}_b AS (SELECT quantile_cont(CAST(us AS DOUBLE), 0.7) AS b FROM {name}),
      {name}_c AS (SELECT count(*) FILTER (us < b) AS early, count(*) FILTER (us >= b) AS late,
        count(*) FILTER ({sql_bucket('sig', 100)} < 70) AS hearly, count(*) FILTER ({sql_bucket('sig', 100)} >= 70) AS hlate FROM {name}, {name}_b)"""


SQL_POOLS = f"""{_sql_unique('even', "label = 'attack' AND row_id % 2 = 0")},
      pool AS (SELECT 'in_distribution' AS pool, url_path_raw, url_query, request_body FROM even WHERE {sql_bucket('sig', 10)} >= 7
        UNION ALL SELECT 'cross_tool', url_path_raw, url_query, request_body FROM v_flows WHERE label = 'attack' AND row_id % 2 = 1 AND attack_tool = 'custom'),
      pools AS (SELECT pool, count(*) AS n FROM pool GROUP BY 1)"""


def _sql_sets(prefix: str, name: str, late: str = "late") -> str:
    return f"""SELECT '{prefix}late_benign/n' AS path, {late} AS n FROM {name}_c WHERE {late} > 0
      UNION ALL SELECT '{prefix}' || pool || '/n', n FROM pools"""


def _sql_rows(prefix: str, name: str, early: str = "early", late: str = "late") -> str:
    calib = f"greatest(1, CAST(floor({early} * 0.15) AS BIGINT))"
    return f"""SELECT '{prefix}rows/train', least({early} - {calib}, 120000) FROM {name}_c UNION ALL SELECT '{prefix}rows/calib', {calib} FROM {name}_c
      UNION ALL SELECT '{prefix}rows/test', {late} FROM {name}_c"""


# --- domains ---------------------------------------------------------------------------------

@query("W8 M1 M2 M6 K5 X4", f"""
    WITH {_sql_unique('va', "label = 'benign' AND app = 'vampi'")}, {_sql_cut('va')}, {_sql_unique('za', "label = 'benign' AND app = 'zanbil'")}, {_sql_cut('za')}, {SQL_POOLS}
    SELECT path, CAST(n AS BIGINT) AS n FROM ({_sql_sets('vampi/rates/', 'va')} UNION ALL {_sql_rows('vampi/', 'va')}
      UNION ALL {_sql_sets('zanbil/rates/', 'za')} UNION ALL {_sql_rows('zanbil/', 'za')})""")
def multi_domain_counts(t):
    """A text model per application, each on its own benign traffic."""
    return _counts(t, jobs.multi_domain({a: _app(_benign(t), a) for a in ("vampi", "zanbil")}, _pools(t), settings=TINY))


@query("W5 M1 M2 M6 X5", f"""
    WITH {_sql_unique('be', "label = 'benign'")}, {_sql_cut('be')}, {SQL_POOLS} SELECT path, CAST(n AS BIGINT) AS n FROM ({_sql_sets('rates/', 'be')})""")
def in_domain_counts(t):
    return _counts(t, jobs.in_domain(_benign(t), _pools(t), TINY))


@query("W10 A12 X6", f"""
    WITH {_sql_unique('va', "label = 'benign' AND app = 'vampi'")}, {_sql_cut('va')}, {_sql_unique('za', "label = 'benign' AND app = 'zanbil'")}, {_sql_cut('za')}, {SQL_POOLS}
    SELECT path, CAST(n AS BIGINT) AS n FROM ({_sql_sets('multi_tenant/rates/', 'va')} UNION ALL {_sql_rows('multi_tenant/', 'va')}
      UNION ALL SELECT 'multi_tenant/rates/own_attacks/n', count(*) FROM v_flows WHERE label = 'attack' AND app = 'vampi'
      UNION ALL SELECT 'multi_tenant/recall_by_rule/' || attack_family || '/n', count(*) FROM v_flows WHERE label = 'attack' AND app = 'vampi' GROUP BY attack_family
      UNION ALL {_sql_sets('multi_tenant/hash_control/rates/', 'va', 'hlate')} UNION ALL {_sql_rows('multi_tenant/hash_control/', 'va', 'hearly', 'hlate')}
      UNION ALL {_sql_sets('filing/rates/', 'za')} UNION ALL {_sql_rows('filing/', 'za')})""")
def further_domain_counts(t):
    """A host with its own rule-labelled attacks, with a hash control, and a benign-only server."""
    flows, pools = _flows(t), _pools(t)
    _, model, _, thresholds = jobs.domain(_app(_benign(t), "zanbil"), pools, settings=TINY)
    return _counts(t, jobs.further_domains(_app(flows, "vampi"), _app(_benign(t), "zanbil"), pools, model, thresholds, settings=TINY, stated_threshold=0.5))


@query("W11 J11 J12", f"""
    WITH {SQL_POOLS} SELECT 'stratified/rates/' || pool || '/n' AS path, n FROM pools""")
def multi_site_counts(t):
    """Attribution of alerts to sites and the split by site; how many attacks the retrained model is judged on."""
    _, model, _, _ = jobs.domain(_benign(t), _pools(t), settings=TINY)
    return _counts(t, jobs.multi_site(_benign(t), _pools(t), model, settings=TINY), r"^stratified/rates/(in_distribution|cross_tool)/n$")


# --- one source against another --------------------------------------------------------------

@query("W3 X8 X11 J4 M3 M4 M5 M7", f"""
    WITH b AS (SELECT app, {SQL_SIG} AS sig FROM v_flows WHERE label = 'benign' GROUP BY 1, 2),
      a AS (SELECT app, {sql_unit("coalesce(attack_family, '') || '|' || url_path_raw || '|' || url_query || '|' || request_body")} AS u FROM v_flows WHERE label = 'attack'),
      d AS (SELECT unnest(['vampi', 'zanbil']) AS a, unnest(['zanbil', 'vampi']) AS b)
    SELECT a || '_to_' || b || '/rates/' || s || '/n' AS path, n FROM (
      SELECT d.a, d.b, 'heldout_benign' AS s, count(*) AS n FROM d JOIN b ON b.app = d.b WHERE NOT EXISTS (
        SELECT 1 FROM b r WHERE r.app = d.a AND r.sig = b.sig AND {sql_unit('r.sig')} < 0.7) GROUP BY 1, 2
      UNION ALL SELECT d.a, d.b, 'attack', count(*) FROM d JOIN a ON a.app = d.b GROUP BY 1, 2
      UNION ALL SELECT d.a, d.b, 'testbed_test', count(*) FROM d, a WHERE u >= 0.85 GROUP BY 1, 2)""")
def single_source_counts(t):
    """Two applications, benign of the one against the other, in both directions."""
    side = lambda a: (_app(_benign(t), a), _app(t.flows.where("label = 'attack'"), a))
    return _counts(t, jobs.single_source_directions(_benign(t).where("http_method = 'POST'"), t.flows.where("label = 'attack'"),
                                                    {a: side(a) for a in ("vampi", "zanbil")}, TINY))


# --- testbed, rules, ablation ----------------------------------------------------------------

SQL_SIDES = """sides AS (SELECT CASE WHEN attack_tool IN ('ffuf', 'sqlmap') THEN 'A' WHEN attack_tool = 'custom' THEN 'B' END AS side, count(*) AS n
        FROM v_flows WHERE attack_family = 'xss' GROUP BY 1),
      tools AS (SELECT CASE side WHEN 'A' THEN 'B_to_A' ELSE 'A_to_B' END AS direction, n FROM sides WHERE (SELECT count(*) FROM sides WHERE n >= 40) = 2)"""


@query("W1 X2 X3 X9 M3 M4 M5 M7 M9", f"""
    WITH s AS (SELECT session_id, split FROM (
        WITH g AS (SELECT src_ip AS session_id, arg_min(label, row_id) AS label, max(attack_family) AS fam, arg_min(attack_tool, row_id) AS tool FROM v_flows GROUP BY 1),
          u AS (SELECT *, {sql_unit('session_id')} AS u, row_number() OVER (PARTITION BY fam ORDER BY session_id) - 1 AS rk, count(*) OVER (PARTITION BY fam) AS n FROM g)
        SELECT session_id, CASE
          WHEN label = 'benign' THEN CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'calib' ELSE 'test' END
          WHEN fam = 'brute_force' THEN CASE WHEN rk < round_even(n * 0.6, 0) THEN 'train'
                WHEN rk < round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'calib' ELSE 'test' END
          WHEN fam = 'bola_idor' THEN 'train' WHEN tool = 'custom' THEN 'test' ELSE 'train' END AS split FROM u)),
      {SQL_SIDES}
    SELECT 'by_marker/' || CASE WHEN {sql_rule(sql_text(), rules.INJECTION_MARKERS)} THEN 'marked' ELSE 'marker_free' END || '/n' AS path, count(*) AS n
    FROM v_flows JOIN s ON session_id = src_ip WHERE split = 'test' AND label = 'attack' GROUP BY 1
    UNION ALL SELECT 'cross_tool/xss/' || direction || '/heldout/n', n FROM tools
    UNION ALL SELECT 'cross_tool/xss/' || direction || '/benign/n', (SELECT count(*) FROM v_flows WHERE label = 'benign' AND {sql_unit('src_ip')} >= 0.8) FROM tools""")
def testbed_counts(t):
    """Session-stratified evaluation, one family's tools against each other, family head."""
    return _counts(t, jobs.testbed(_flows(t), TINY, ["xss"]), r"^(by_marker|cross_tool)/.*/n$")


@query("W6 M13 J6", f"""
    WITH {_sql_unique('be', "label = 'benign'")}, {_sql_cut('be')}, {SQL_POOLS}
    SELECT path, CAST(n AS BIGINT) AS n FROM ({_sql_sets('all_families/rates/', 'be')} UNION ALL {_sql_sets('content_only/rates/', 'be')}) WHERE path NOT LIKE '%cross_tool%'""")
def ablation_counts(t):
    """All families among the positives against content families only."""
    return _counts(t, jobs.ablation(_benign(t), _pools(t), t.flows, TINY), r"rates/(late_benign|in_distribution)/n$")


# --- pairs, reviewed rows --------------------------------------------------------------------

@query("W12 M12 J13", f"""
    WITH {_sql_unique('va', "label = 'benign' AND app = 'vampi'")}, {_sql_cut('va')}, {_sql_unique('za', "label = 'benign' AND app = 'zanbil'")}, {_sql_cut('za')}
    SELECT 'vampi_to_zanbil/n_target' AS path, late AS n FROM za_c UNION ALL SELECT 'zanbil_to_vampi/n_target', late FROM va_c""")
def representation_pair_counts(t):
    """How near another application's late benign requests lie to those a model was trained on, in both directions."""
    cut = {a: settle(splits.temporal_split(_app(_benign(t), a))) for a in ("vampi", "zanbil")}
    role = lambda a, r: cut[a].where(F.col("role") == r)
    attacks = dedup.keep_first(t.flows.where("label = 'attack'"))
    pairs = {f"{a}_to_{b}": (role(a, "train"), role(a, "calib"), role(b, "test"), attacks) for a, b in (("vampi", "zanbil"), ("zanbil", "vampi"))}
    return _counts(t, jobs.representation_pairs(pairs, TINY), r"/n_target$")


@query("W13 J7 Q12 S12 J15 A19 A20", f"""
    WITH d AS (SELECT http_method, {sql_decode(sql_text())} AS dec, arg_min(attack_family, row_id) AS family FROM v_flows WHERE label = 'attack' GROUP BY 1, 2)
    SELECT 'per_family/' || family || '/support' AS path, count(*) AS n FROM d GROUP BY 1
    UNION ALL SELECT 'labelled/' || family || '/n', count(*) FROM d GROUP BY 1""")
def family_sample_counts(t):
    """Reviewed rows read from CSV, their requests found again by decoded text, the family head judged on them."""
    attacks = t.flows.where("label = 'attack'")
    keyed = attacks.withColumn("dec", X.decode(X.request_text()))
    reviewed = dedup.first_per_key(keyed, ["http_method", "dec"]).select(
        F.col("row_id").alias("row_index"), "http_method", "dec", F.col("attack_family").alias("family_label"), F.lit("").alias("pred_family"))
    path = scratch_path(t.spark, "reviewed")
    reviewed.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    labels = tables.annotations(t.spark, path)
    sample = settle(jobs.rebuild_family_sample(labels, attacks))
    result = jobs.family_evaluation(sample, D.fit_family(attacks, TINY))
    named = membership.label_rows(sample.select("row_index"), labels.select("row_index", F.col("family_label").alias("name")))
    labelled = {r.name: {"n": r["count"]} for r in named.groupBy("name").count().collect()}
    return _counts(t, result | {"labelled": labelled}, r"(^|/)(n|support)$")


# --- stored models, samples, corpus ----------------------------------------------------------

@query("W2 K7 M7 M14", """
    SELECT label || '/n' AS path, count(*) AS n FROM v_flows GROUP BY 1 UNION ALL SELECT 'same_thresholds/n', 1
    UNION ALL SELECT 'own_threshold_found_again/n', 1""")
def external_scoring_counts(t):
    """A stored detector, loaded again, over raw traffic; its text channel derives its operating point again."""
    rows = dedup.keep_first(t.flows).withColumn("y", (F.col("label") == "attack").cast("int"))
    cut = settle(splits.session_split(rows, "src_ip"))
    calib = cut.where("split = 'calib'")
    model = D.fit_detector(cut.where("split = 'train'"), calib, TINY)
    path = scratch_path(t.spark, "detector")
    model.save(path)
    again = D.Detector.load(path)
    found = D.text_thresholds(again.text, calib.where("y = 0"))
    result = jobs.external_scoring(again, {r: t.flows.where(F.col("label") == r) for r in ("benign", "attack")})
    return _counts(t, result | {"same_thresholds": {"n": int(again.thresholds == model.thresholds)},
                                "own_threshold_found_again": {"n": int(found == model.thresholds["p_text"])}}, r"/n$")


@query("W15 U2 J1 J2 X2 Q1 Q2 Q8", f"""
    WITH {SQL_MATCHED}
    SELECT CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'calib' ELSE 'test' END AS split, label, count(*) AS n, TRUE AS apart
    FROM (SELECT *, {sql_unit('session_id')} AS u FROM lab) GROUP BY 1, 2""")
def corpus_build_counts(t):
    """Two captures labelled, merged, split by session and checked."""
    bare = t.flows.drop("label", "attack_family", "attack_tool")
    corpus, checks = jobs.build_corpus([bare.where("row_id % 2 = 0"), bare.where("row_id % 2 = 1")], t.campaigns, True)
    apart = checks.where("check_name = 'session_split_disjoint'").select(F.col("ok").alias("apart"))
    return corpus.groupBy("split", "label").agg(F.count("*").alias("n")).crossJoin(apart)  # a single row


# --- reports ---------------------------------------------------------------------------------

@query("T2 K4 A10", f"""
    SELECT url_path_raw AS site, count(*) AS n_test, count(*) FILTER ({sql_any_rule(sql_decode(sql_text()))}) AS alerts
    FROM v_flows GROUP BY 1 ORDER BY alerts DESC, site LIMIT 15""")
def top_sites_report(t):
    """The fifteen sites with the most alerts, written as CSV and read back."""
    f = t.flows.withColumns({"site": F.col("url_path_raw"), "alert": rules.any_rule(X.decode(X.request_text()))})
    per = metrics.site_attribution(f, f.where("row_id % 3 = 0"), f.groupBy("site").agg(F.min("timestamp").alias("first_seen")), F.lit("2024-01-21"))
    path = scratch_path(t.spark, "sites")
    sinks.write_sites(metrics.top_sites(per), path)
    return t.spark.read.csv(path, header=True).select("site", F.col("n_test").cast("long").alias("n_test"), F.col("alerts").cast("long").alias("alerts"))


@query("K3 T1 A25", f"""
    SELECT http_method, url_path_raw, url_query, row_id * 0.5::DOUBLE AS score, {sql_rule(sql_decode(sql_text()), rules.DECODED_MARKERS)} AS marked
    FROM v_flows ORDER BY row_id DESC LIMIT 100""")
def review_report(t):
    """The top alerts with what the audit markers say, written as CSV for review and read back."""
    path = scratch_path(t.spark, "review")
    sinks.write_review(jobs.review(t.flows.withColumn("score", F.col("row_id") * 0.5), "score", 0.0), path, "score")
    return t.spark.read.csv(path, header=True).select(
        "http_method", "url_path_raw", "url_query", F.col("score").cast("double").alias("score"), F.col("marked").cast("boolean").alias("marked"))
