"""Rates, curves, quantiles, rankings, neighbours and payload rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.catalog.registry import query
from wiretally.catalog.text_queries import (SQL_GRAMS, page_texts, sql_any_rule, sql_bucket, sql_decode, sql_hits, sql_rule, sql_text)
from wiretally.functions import clock, hashing as H, rules, text as X
from wiretally.operators import metrics, mutations, neighbours, quality, quantiles, ranking
from wiretally.session import tabled

R = 0.5  # alert threshold used where a query needs a fixed one


def r6(c):
    return F.round(c, 6)


# --- quantiles -------------------------------------------------------------------------------

@query("A13 M6", """
    SELECT b AS budget, (SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS rk, count(*) OVER () AS n
        FROM v_scores WHERE NOT y) WHERE rk = CAST(ceil((n - 1) * (1 - b)) AS BIGINT)) AS threshold
    FROM (SELECT unnest([0.01::DOUBLE, 0.05]) AS b)""")
def budget_thresholds(t):
    """Alert thresholds at two false-positive budgets over scores with many ties."""
    found = quantiles.budget_thresholds(t.scores.where(~F.col("y")), "score")
    return t.spark.createDataFrame(sorted(found.items()), "budget double, threshold double")


@query("A13 A15", """
    WITH r AS (SELECT l_suppkey, score, row_number() OVER (PARTITION BY l_suppkey ORDER BY score) - 1 AS rk,
                      count(*) OVER (PARTITION BY l_suppkey) AS n FROM v_scores WHERE NOT y)
    SELECT l_suppkey, b AS budget, min(score) FILTER (rk = CAST(ceil((n - 1) * (1 - b)) AS BIGINT)) AS threshold
    FROM r, (SELECT unnest([0.01::DOUBLE, 0.05]) AS b) GROUP BY 1, 2""")
def group_budget_thresholds(t):
    return quantiles.group_budget_thresholds(t.scores.where(~F.col("y")), "score", ["l_suppkey"])


@query("A14", """
    SELECT round(quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.7), 0) AS boundary, round(quantile_cont(value, 0.5), 6) AS median FROM events""")
def time_boundary(t):
    """Linear quantiles: the 70 % point of time and a median."""
    b = quantiles.quantile_linear(t.events, F.unix_micros(F.col("ts").cast("timestamp")).cast("double"), 0.7)
    m = quantiles.quantile_linear(t.events, "value", 0.5)
    return t.spark.createDataFrame([(b, m)], "boundary double, median double").select(
        F.round("boundary", 0).alias("boundary"), r6("median").alias("median"))


@query("A15", "SELECT user_id, count(*) AS n, round(quantile_cont(value, 0.7), 6) AS boundary FROM events GROUP BY 1")
def group_boundaries(t):
    return quantiles.group_quantile_linear(t.events, "value", 0.7, ["user_id"], "boundary").withColumn(
        "boundary", r6("boundary"))


# --- curves and rates ------------------------------------------------------------------------

@query("A16 A17", """
    WITH g AS (SELECT score, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM v_scores GROUP BY 1),
      c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS nb,
                   sum(pos) OVER (ORDER BY score DESC)::DOUBLE AS tp, sum(neg) OVER (ORDER BY score DESC)::DOUBLE AS fp FROM g)
    SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
      round(sum(pos * (nb + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS roc_auc,
      round(sum(pos * tp / (tp + fp)) / sum(pos)::DOUBLE, 6) AS pr_auc FROM c""")
def ranking_quality(t):
    return metrics.ranking_quality(t.scores, "score", F.col("y")).withColumns(
        {"roc_auc": r6("roc_auc"), "pr_auc": r6("pr_auc")})


@query("A18 F8", f"""
    SELECT channel, CAST(tp AS BIGINT) AS tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
           round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr
    FROM (SELECT channel, count(*) FILTER (score >= {R} AND y) AS tp, count(*) FILTER (score >= {R} AND NOT y) AS fp,
                 count(*) FILTER (score < {R} AND y) AS fn, count(*) FILTER (score < {R} AND NOT y) AS tn FROM v_scores GROUP BY 1)""")
def threshold_metrics(t):
    m = metrics.threshold_metrics(t.scores, "score", F.col("y"), R, ["channel"])
    return m.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "fpr")})


@query("A19", """
    SELECT truth, predicted, count(*) AS n FROM v_scores GROUP BY 1, 2""")
def confusion_table(t):
    return metrics.confusion(t.scores, "truth", "predicted")


@query("A19 U5", """
    WITH c AS (SELECT unnest(['A', 'N', 'R']) AS label)
    SELECT label, count(*) FILTER (truth = label) AS support,
           round(count(*) FILTER (truth = label AND predicted = label) / count(*) FILTER (predicted = label), 6) AS precision,
           round(count(*) FILTER (truth = label AND predicted = label) / count(*) FILTER (truth = label), 6) AS recall
    FROM c, v_scores GROUP BY label""")
def class_report(t):
    return metrics.class_report(t.scores, "truth", "predicted").withColumns(
        {"precision": r6("precision"), "recall": r6("recall")})


@query("A2 A3 A4", f"""
    SELECT truth AS evaluation_set, 'score' AS channel, b AS budget, count(*) AS n, round(avg(CAST(score >= th AS INT)), 6) AS alert_rate
    FROM v_scores, (SELECT unnest([0.01::DOUBLE, 0.05]) AS b, unnest([0.69::DOUBLE, 0.66]) AS th) GROUP BY 1, 2, 3""")
def alert_rates(t):
    """All evaluation sets at all budgets in one pass."""
    rates = metrics.alert_rates(t.scores.withColumn("evaluation_set", F.col("truth")),
                                [("score", 0.01, 0.69), ("score", 0.05, 0.66)])
    return rates.withColumn("alert_rate", r6("alert_rate"))


@query("A5", f"""
    WITH d AS (SELECT {sql_any_rule(sql_decode(sql_text()))} AS marked, row_id % 10 < 7 AS hit FROM v_flows WHERE label = 'attack')
    SELECT CASE WHEN marked IS NULL THEN 'overall' WHEN marked THEN 'marked' ELSE 'marker_free' END AS part, count(*) AS n,
           round(avg(CAST(hit AS INT)), 6) AS ml_recall, round(avg(CAST(m2 AS INT)), 6) AS rule_recall
    FROM (SELECT marked, hit, marked AS m2 FROM d UNION ALL SELECT NULL, hit, marked FROM d) GROUP BY 1""")
def recall_by_marker(t):
    atk = t.flows.where(F.col("label") == "attack")
    m = metrics.recall_by_marker(atk, F.col("row_id") % 10 < 7, rules.any_rule(X.decode(X.request_text())))
    return m.withColumns({"ml_recall": r6("ml_recall"), "rule_recall": r6("rule_recall")})


@query("A12", f"""
    SELECT attack_family AS gt_rule, count(*) AS n, round(avg(CAST(row_id % 10 < 7 AS INT)), 6) AS recall FROM v_flows WHERE label = 'attack' GROUP BY 1""")
def recall_by_rule(t):
    return t.flows.where(F.col("label") == "attack").groupBy(F.col("attack_family").alias("gt_rule")).agg(
        F.count("*").alias("n"), r6(metrics.share(F.col("row_id") % 10 < 7)).alias("recall"))


@query("A20", f"""
    WITH d AS (SELECT attack_family, {sql_hits(sql_decode(sql_text()))} AS h FROM v_flows WHERE label = 'attack')
    SELECT count(*) AS n_fired, round(avg(CAST(list_contains(h, attack_family) AS INT)), 6) AS agreement FROM d WHERE len(h) > 0""")
def annotator_agreement(t):
    atk = t.flows.where(F.col("label") == "attack")
    return metrics.annotator_agreement(atk, rules.rule_hits(X.decode(X.request_text())), F.col("attack_family")).withColumn(
        "agreement", r6("agreement"))


@query("A21", """
    WITH p AS (SELECT attack_tool, attack_family, avg(CAST(row_id % 10 < 7 AS INT)) AS recall, count(*) AS n FROM v_flows WHERE label = 'attack' GROUP BY 1, 2)
    SELECT attack_tool, round(avg(recall), 6) AS recall, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1""")
def macro_recall(t):
    per = t.flows.where(F.col("label") == "attack").groupBy("attack_tool", "attack_family").agg(
        metrics.share(F.col("row_id") % 10 < 7).alias("recall"), F.count("*").alias("n"))
    return metrics.macro_mean(per, "recall", ["attack_tool"]).withColumn("recall", r6("recall"))


@query("A10 A11 J11 J12", """
    WITH f AS (SELECT *, 'u' || CAST(user_id AS VARCHAR) AS site, row_id % 10 < 3 AS alert FROM v_flows),
      tr AS (SELECT DISTINCT site FROM f WHERE timestamp < '2024-01-21' AND user_id % 4 <> 0), fs AS (SELECT site, min(timestamp) AS first_seen FROM f GROUP BY 1),
      g AS (SELECT site, count(*) AS n_test, count(*) FILTER (alert) AS alerts FROM f WHERE timestamp >= '2024-01-21' GROUP BY 1)
    SELECT site, n_test, alerts, round(alerts / n_test, 6) AS alert_rate, tr.site IS NOT NULL AS in_train, first_seen,
           first_seen >= '2024-01-21' AS appeared_after_split
    FROM g LEFT JOIN tr USING (site) JOIN fs USING (site)""")
def site_attribution(t):
    f = _sited(t)
    late = f.where(F.col("timestamp") >= "2024-01-21")
    train = f.where((F.col("timestamp") < "2024-01-21") & (F.col("user_id") % 4 != 0))
    seen = f.groupBy("site").agg(F.min("timestamp").alias("first_seen"))
    return metrics.site_attribution(late, train, seen, F.lit("2024-01-21")).withColumn("alert_rate", r6("alert_rate"))


def _sited(t):
    return t.flows.withColumns({"site": F.concat(F.lit("u"), F.col("user_id").cast("string")),
                                "alert": F.col("row_id") % 10 < 3})


@query("A11", """
    WITH f AS (SELECT *, 'u' || CAST(user_id AS VARCHAR) AS site, row_id % 10 < 3 AS alert FROM v_flows),
      tr AS (SELECT DISTINCT site FROM f WHERE timestamp < '2024-01-21' AND user_id % 4 <> 0),
      g AS (SELECT site, count(*) AS n, count(*) FILTER (alert) AS a, bool_or(user_id % 4 <> 0) AS cov FROM f WHERE timestamp >= '2024-01-21' GROUP BY 1)
    SELECT count(*) AS sites, count(*) FILTER (cov) AS covered_sites, CAST(sum(n) FILTER (cov) AS BIGINT) AS covered_n,
      CAST(sum(n) FILTER (NOT cov) AS BIGINT) AS uncovered_n, round(sum(a) FILTER (cov) / sum(n) FILTER (cov), 6) AS covered_rate,
      round(sum(a) FILTER (NOT cov) / sum(n) FILTER (NOT cov), 6) AS uncovered_rate, round(sum(a) FILTER (NOT cov) / sum(a), 6) AS uncovered_share
    FROM (SELECT g.site, n, a, tr.site IS NOT NULL AS cov FROM g LEFT JOIN tr USING (site))""")
def coverage_of_sites(t):
    f = _sited(t)
    late = f.where(F.col("timestamp") >= "2024-01-21")
    train = f.where((F.col("timestamp") < "2024-01-21") & (F.col("user_id") % 4 != 0))
    seen = f.groupBy("site").agg(F.min("timestamp").alias("first_seen"))
    per = metrics.site_attribution(late, train, seen, F.lit("2024-01-21"))
    return metrics.coverage_summary(per).withColumns(
        {c: r6(c) for c in ("covered_rate", "uncovered_rate", "uncovered_share")})


# --- rankings --------------------------------------------------------------------------------

@query("T1 F8", "SELECT row_id, score FROM v_scores WHERE score >= 0.5 ORDER BY score DESC, row_id LIMIT 100")
def top_alerts(t):
    return ranking.top_alerts(t.scores, "score", R).select("row_id", "score")


@query("T1 F5 F6 A25", f"""
    WITH s AS (SELECT *, {sql_bucket('CAST(row_id AS VARCHAR)', 1000)} / 1000.0::DOUBLE AS p FROM v_flows WHERE label = 'benign'),
      top AS (SELECT *, {sql_rule(sql_decode(sql_text()), rules.DECODED_MARKERS)} AS marked FROM (
        SELECT * FROM s WHERE p >= 0.9 ORDER BY p DESC, row_id LIMIT 100)),
      a AS (SELECT avg(CAST(p >= 0.9 AS INT)) AS rate FROM s), r AS (SELECT count(*) AS n_top, count(*) FILTER (marked) AS n_marked FROM top)
    SELECT n_top, n_marked, round(rate, 6) AS alert_rate, round(rate * CASE WHEN n_top > 0 THEN (n_top - n_marked) / n_top ELSE 1.0 END, 6) AS corrected
    FROM a, r""")
def reviewed_alerts(t):
    """The top 100 alerts on benign, how many carry a marker, and the corrected alert rate."""
    from wiretally.plans.jobs import review
    s = t.flows.where(F.col("label") == "benign").withColumn(
        "p", H.bucket(F.col("row_id").cast("string"), 1000) / F.lit(1000.0))
    top = review(s, "p", 0.9)
    counts = top.agg(F.count("*").alias("n_top"), F.count_if("marked").alias("n_marked"))
    rate = s.agg(metrics.share(F.col("p") >= 0.9).alias("r")).scalar()
    return counts.withColumn("alert_rate", rate).select(
        "n_top", "n_marked", r6("alert_rate").alias("alert_rate"),
        r6(metrics.corrected_rate(F.col("alert_rate"), F.col("n_top"), F.col("n_marked"))).alias("corrected"))


@query("A1 A8 A23", """
    SELECT event_type, count(*) AS n, count(DISTINCT (user_id, epoch_us(date_trunc('millisecond', ts)) // 10000000)) AS windows,
           count(DISTINCT json_extract_string(props, '$.k')) AS features FROM events GROUP BY 1""")
def window_counts(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.struct("user_id", clock.window_number(F.col("ts")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(w).alias("windows"),
                                       F.count_distinct(F.get_json_object("props", "$.k")).alias("features"))


@query("A23", """
    SELECT DISTINCT 'k' || json_extract_string(props, '$.k') AS feature FROM events WHERE event_type = 'view'""")
def covered_features(t):
    """Union of the feature lists of benign campaigns (one list per user)."""
    c = t.events.groupBy("user_id", "event_type").agg(F.collect_set(
        F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("feature_coverage"))
    c = c.select(F.when(F.col("event_type") == "view", "benign").otherwise("attack").alias("label"), F.lit("crapi").alias("app"),
                 F.struct("feature_coverage").alias("extra"))
    return quality.covered_features(c)


# --- neighbours ------------------------------------------------------------------------------

SQL_NEAREST = f"""
    s AS (SELECT vec_id, embedding::DOUBLE[] AS v, {sql_bucket('CAST(vec_id AS VARCHAR)', 10)} AS b FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, q.b, max(list_cosine_similarity(q.v, t.v)) AS similarity
          FROM s q JOIN s t ON q.b >= 5 AND t.b < 5 GROUP BY 1, 2)"""


def _nearest(t):
    b = H.bucket(F.col("vec_id").cast("string"), 10)
    v = t.embeddings.withColumn("b", b)
    return v, neighbours.nearest_dense(v.where("b >= 5"), v.where("b < 5"), "embedding", "vec_id")


@query("J13", f"WITH {SQL_NEAREST} SELECT query_id, round(similarity, 5) AS similarity FROM d")
def nearest_training_vector(t):
    """Largest cosine similarity of every target vector to any training vector."""
    return _nearest(t)[1].withColumn("similarity", F.round("similarity", 5))


@query("M12 A27 F9 A14 A24", f"""
    WITH {SQL_NEAREST}, x AS (SELECT 1 - similarity AS distance, b, query_id, {sql_bucket('CAST(query_id AS VARCHAR)', 1000)} / 1000.0::DOUBLE AS score FROM d),
      r AS (SELECT unnest([0.01::DOUBLE, 0.05]) AS budget, unnest([0.97::DOUBLE, 0.9]) AS threshold,
                   unnest([quantile_cont(distance, 0.99), quantile_cont(distance, 0.95)]) AS radius FROM x WHERE b < 7),
      o AS (SELECT budget, radius, threshold, count(*) AS n, avg(CAST(distance > radius AS INT)) AS eps, avg(CAST(score >= threshold AS INT)) AS alert_rate,
                   avg(CAST(score >= threshold AS INT)) FILTER (distance <= radius) AS alert_rate_inside FROM x, r WHERE b >= 7 GROUP BY 1, 2, 3)
    SELECT budget, round(radius, 5) AS radius, threshold, n, round(eps, 6) AS eps, round(alert_rate, 6) AS alert_rate,
           round(alert_rate_inside, 6) AS alert_rate_inside, alert_rate <= eps + 0.01 AS bound_holds FROM o""")
def representation_coverage(t):
    """Radius from calibration distances, share outside it, alert rates and the bound."""
    v, near = _nearest(t)
    d = near.join(v.select(F.col("vec_id").alias("query_id"), "b"), "query_id").select(
        "b", (1 - F.col("similarity")).alias("distance"),
        (H.bucket(F.col("query_id").cast("string"), 1000) / F.lit(1000.0)).alias("score"))
    out = neighbours.coverage(d.where("b < 7"), d.where("b >= 7"), {0.01: 0.97, 0.05: 0.9})
    return out.withColumns({c: r6(c) for c in ("eps", "alert_rate", "alert_rate_inside")} | {"radius": F.round("radius", 5)})


@query("J13 M1", f"""
    WITH {SQL_GRAMS},
         tf AS (SELECT row_id, term, count(*) AS tf FROM g GROUP BY ALL),
         tr AS (SELECT * FROM tf WHERE row_id % 2 = 0),
         df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM u WHERE row_id % 2 = 0)) / (1 + count(*))) + 1 AS idf FROM tr GROUP BY term HAVING count(*) >= 2),
         w AS (SELECT row_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN df USING (term)),
         n AS (SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM w),
         p AS (SELECT q.row_id AS query_id, t.row_id, sum(q.w * t.w) AS dot FROM n q JOIN n t ON q.term = t.term
               WHERE q.row_id % 2 = 1 AND t.row_id % 2 = 0 GROUP BY 1, 2)
    SELECT u.row_id AS query_id, round(coalesce(max(dot), 0), 5) AS similarity
    FROM u LEFT JOIN p ON u.row_id = p.query_id WHERE u.row_id % 2 = 1 GROUP BY 1""")
def nearest_training_request(t):
    """The same in the detector's own n-gram space: whole pages, odd rows against even rows."""
    from wiretally.plans.vectors import TfIdf
    texts = tabled(page_texts(t), "texts")
    train, target = texts.where(F.col("row_id") % 2 == 0), texts.where(F.col("row_id") % 2 == 1)
    model = TfIdf("s", "v").fit(train)
    # A page's vector is many times as large as its text: the operator moves texts and makes their vectors where they are compared.
    near = neighbours.nearest_sparse(target, train, "row_id", ["s"], model.reader(), f"length(s) <= {neighbours.PIVOT_TERMS}", "length(s) > 2")
    return near.withColumn("similarity", F.round("similarity", 5))


# --- payload rewrites ------------------------------------------------------------------------

def _sql_draw(salt: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5(seed || ':' || {salt}), 1, 8) AS BIGINT) % {n})"


def _sql_choice(options, salt: str) -> str:
    items = ", ".join("chr(0)" if o == "\x00" else "'" + o.replace("'", "''") + "'" for o in options)
    return f"[{items}][{_sql_draw(salt, len(options))} + 1]"


_SQL_ENCODED = "replace(replace(url_encode({0}), '+', '%20'), '*', '%2A')"
_SQL_CASE = ("array_to_string(list_transform(string_split({0}, ''), lambda c, i: CASE WHEN CAST('0x' || substr(md5(seed || ':' || "
             "CAST(i - 1 AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0 THEN upper(c) ELSE lower(c) END), '')")
SQL_REWRITES = {
    "case": _SQL_CASE.format("s"),
    "versioned_comment": r"regexp_replace(s, '\b(union|select|or|and)\b', '/*!50000\1*/', 'gi')",
    "whitespace_sub": "array_to_string(list_transform(string_split(s, ' '), lambda p, i: CASE WHEN i < len(string_split(s, ' ')) THEN p || "
                      + _sql_choice(mutations.BLANKS, "CAST(i - 1 AS VARCHAR)") + " ELSE p END), '')",
    "url_encode": _SQL_ENCODED.format("s"),
    "double_url_encode": _SQL_ENCODED.format(_SQL_ENCODED.format("s")),
    "html_entity": "array_to_string(list_transform(string_split(s, ''), lambda c: CASE WHEN contains('"
                   + mutations.ENTITY_CHARACTERS.replace("'", "''") + "', c) THEN '&#' || CAST(ascii(c) AS VARCHAR) || ';' ELSE c END), '')",
    "equivalent_syntax": "CASE WHEN " + _sql_draw("'like'", 10) + r" < 3 THEN regexp_replace(e, '=\s*', ' LIKE ', 'g') ELSE e END",
    "xss_alt": "regexp_replace(replace(regexp_replace(s, '<script', '<' || " + _SQL_CASE.format("'script'")
               + r", 'gi'), 'javascript:', 'java' || chr(9) || 'script:'), 'onerror', 'OnErRoR', 'gi')",
    "null_terminator": "s || " + _sql_choice(mutations.TERMINATORS, "'end'"),
}


def _sql_mutations() -> str:
    parts = ["SELECT row_id, 'original' AS mutation, md5(s) AS mutated_md5 FROM b"]
    for name, expr in SQL_REWRITES.items():
        fams = ", ".join(f"'{f}'" for f in mutations.APPLIES_TO[name])
        parts.append(f"SELECT row_id, '{name}', md5({expr}) FROM b WHERE attack_family IN ({fams})")
    return f"""
    WITH a AS (SELECT row_id, attack_family, {sql_decode(sql_text())} AS s, md5({sql_decode(sql_text())}) AS seed FROM v_flows WHERE label = 'attack'),
      b AS (SELECT *, replace(regexp_replace(s, '1\\s*=\\s*1', {_sql_choice(mutations.TAUTOLOGIES, "'tautology'")}, 'gi'), '''1''=''1''', '''a''=''a''') AS e FROM a)
    {' UNION ALL '.join(parts)}"""


@query("V0 V1 V3 V4 V5 V6 V7 V8 V10 V11 J14", _sql_mutations())
def payload_rewrites(t):
    """Every attack payload under each applicable rewrite (the two regex-callback ones apart)."""
    base = t.flows.where(F.col("label") == "attack").select(
        "row_id", "attack_family", X.decode(X.request_text()).alias("payload"))
    out = mutations.mutate(base).where(~F.col("mutation").isin("inline_comment", "keyword_char"))
    return out.select("row_id", "mutation", F.md5("mutated").alias("mutated_md5"))


@query("V2 V9")
def callback_rewrites(t):
    """Comment insertion and character codes; their twins in plain Python are in the tests."""
    base = t.flows.where(F.col("attack_family") == "sqli").select(
        "row_id", "attack_family", X.decode(X.request_text()).alias("payload"))
    out = mutations.mutate(base).where(F.col("mutation").isin("inline_comment", "keyword_char"))
    return out.select("row_id", "mutation", "mutated")


@query("J14 F2 A21 W9", f"""
    WITH a AS (SELECT attack_family, {sql_decode(sql_text())} AS s FROM v_flows WHERE label = 'attack' AND attack_family IN ('sqli', 'xss', 'path_traversal')),
      m AS (SELECT attack_family, 'original' AS mutation, s AS x FROM a UNION ALL SELECT attack_family, 'double_url_encode', {_SQL_ENCODED.format(_SQL_ENCODED.format('s'))} FROM a),
      p AS (SELECT mutation, attack_family, avg(CAST({sql_any_rule(sql_decode('x'))} AS INT)) AS recall, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT mutation, round(avg(recall), 6) AS recall, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1""")
def rule_recall_under_encoding(t):
    """Macro recall of the rules on originals and on doubly encoded payloads."""
    base = t.flows.where(F.col("attack_family").isin("sqli", "xss", "path_traversal")).select(
        "row_id", "attack_family", X.decode(X.request_text()).alias("payload"))
    m = mutations.mutate(base).where(F.col("mutation").isin("original", "double_url_encode"))
    per = m.groupBy("mutation", "attack_family").agg(
        metrics.share(rules.any_rule(X.decode("mutated"))).alias("recall"), F.count("*").alias("n"))
    return metrics.macro_mean(per, "recall", ["mutation"]).withColumn("recall", r6("recall"))
