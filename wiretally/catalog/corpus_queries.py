"""Labelling, joins, deduplication, splits and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.catalog.registry import query
from wiretally.catalog.text_queries import (SQL_SIG, sql_any_rule, sql_bucket, sql_decode, sql_place,
                                            sql_rule, sql_text, sql_unit)
from wiretally.functions import rules, text as X
from wiretally.operators import dedup, labelling, membership, quality, ranking, splits

# --- labelling -------------------------------------------------------------------------------

SQL_MATCHED = """
    m AS (SELECT f.row_id, min(c.ord) AS ord FROM v_flows f JOIN v_campaigns c
          ON f.src_ip = c.src_ip AND f.timestamp >= c.start_ts AND f.timestamp <= c.end_ts GROUP BY f.row_id),
    lab AS (SELECT f.row_id, f.timestamp, f.src_ip, f.http_method, f.url_path_raw, f.url_query, f.request_body,
              f.response_status, f.app, c.label, c.attack_family, c.attack_tool, c.campaign_id,
              CASE WHEN f.app = 'vampi' THEN 'vampi:user:u' || CAST(f.user_id AS VARCHAR) ELSE f.app || ':ip:' || f.src_ip END AS session_id,
              'campaign=' || c.campaign_id || ' tool=' || coalesce(c.attack_tool, 'None') || ' src=' || c.src_ip
                || ' window=[' || c.start_ts || ',' || c.end_ts || ')' AS label_source
            FROM m JOIN v_flows f USING (row_id) JOIN v_campaigns c USING (ord))"""


def _labelled(t):
    return labelling.label_flows(
        t.flows.drop("label", "attack_family", "attack_tool"), t.campaigns)


@query("J1 P16", f"""
    WITH {SQL_MATCHED} SELECT row_id, session_id, label, attack_family, attack_tool, campaign_id, label_source FROM lab""")
def label_flows(t):
    """First campaign of the same source whose closed window holds the flow."""
    return _labelled(t).select("row_id", "session_id", "label", "attack_family", "attack_tool", "campaign_id", "label_source")


@query("J2", f"""
    WITH {SQL_MATCHED} SELECT f.row_id, f.src_ip FROM v_flows f LEFT JOIN m USING (row_id) WHERE m.ord IS NULL""")
def unmatched_flows(t):
    return labelling.unmatched_flows(t.flows, t.campaigns).select("row_id", "src_ip")


@query("J3 Q2", f"""
    WITH {SQL_MATCHED}
    SELECT l.row_id FROM lab l WHERE l.label = 'benign' AND EXISTS (
      SELECT 1 FROM v_campaigns c WHERE c.label = 'attack' AND c.src_ip = l.src_ip
        AND l.timestamp >= c.start_ts AND l.timestamp <= c.end_ts)""")
def benign_in_attack_windows(t):
    benign = _labelled(t).where(F.col("label") == "benign").drop(
        "attack_family", "attack_tool", "campaign_id", "label_source")
    return labelling.rows_in_attack_windows(benign, t.campaigns).select("row_id")


# --- deduplication and key lookups -----------------------------------------------------------

@query("D1", f"SELECT min(row_id) AS row_id, md5({SQL_SIG}) AS sig FROM v_docs GROUP BY {SQL_SIG}")
def keep_first_documents(t):
    """Exact copies among whole documents: the first of each stays."""
    return dedup.keep_first(t.posts).select("row_id", F.md5(X.signature()).alias("sig"))


@query("D1 A1", f"""
    SELECT label, attack_family, count(*) AS n FROM (
      SELECT arg_min(label, row_id) AS label, arg_min(coalesce(attack_family, '-'), row_id) AS attack_family
      FROM v_flows GROUP BY {SQL_SIG}) GROUP BY 1, 2""")
def unique_flow_counts(t):
    first = dedup.keep_first(t.flows.withColumn("attack_family", F.coalesce("attack_family", F.lit("-"))))
    return first.groupBy("label", "attack_family").agg(F.count("*").alias("n"))


@query("P1 P3 P6 P19 D1 X1 F2 A1", f"""
    WITH u AS (SELECT min(row_id) AS row_id FROM v_flows GROUP BY {SQL_SIG}),
      s AS (SELECT {sql_unit(SQL_SIG)} AS h, {sql_any_rule(sql_decode(sql_text()))} AS flagged FROM v_flows JOIN u USING (row_id))
    SELECT CASE WHEN h < 0.6 THEN 'train' WHEN h < 0.8 THEN 'calib' ELSE 'test' END AS split,
           count(*) AS n, count(*) FILTER (flagged) AS flagged FROM s GROUP BY 1""")
def flagged_by_split(t):
    """Unique requests, split by the hash of their signature, flagged by the rules, counted."""
    unique = dedup.keep_first(t.flows)
    marked = unique.select(splits.three_way(X.signature()).alias("split"),
                           rules.any_rule(X.decode(X.request_text())).alias("hit"))
    return marked.groupBy("split").agg(F.count("*").alias("n"), F.count_if("hit").alias("flagged"))


@query("J4 J5", f"""
    SELECT row_id FROM v_flows WHERE {SQL_SIG} NOT IN
      (SELECT {SQL_SIG} FROM v_flows WHERE timestamp < '2024-01-20')""")
def exclude_seen_requests(t):
    """Late requests never seen in the early slice."""
    early = t.flows.where(F.col("timestamp") < "2024-01-20")
    return membership.exclude_seen(t.flows, early).select("row_id")


@query("J5", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark)")
def exclude_given_keys(t):
    return membership.exclude_keys(t.documents, t.benchmark, "text").select("doc_id")


@query("J6", f"""
    WITH last AS (SELECT {SQL_SIG} AS sig, arg_max(coalesce(attack_family, '-'), row_id) AS fam FROM v_flows GROUP BY 1)
    SELECT row_id, CASE WHEN f.app = 'vampi' THEN fam END AS attack_family
    FROM v_flows f JOIN last ON last.sig = {SQL_SIG}""")
def recover_families(t):
    known = t.flows.withColumn("attack_family", F.coalesce("attack_family", F.lit("-")))
    return membership.recover_family(known.withColumn("source_id", F.col("app")), known, source="vampi").select(
        "row_id", "attack_family")


@query("J7 U4 Q12", f"""
    WITH d AS (SELECT row_id, http_method, {sql_decode(sql_text())} AS dec FROM v_flows),
         w AS (SELECT max(row_id) AS row_index, http_method, dec FROM d WHERE row_id % 2 = 0 GROUP BY 2, 3)
    SELECT w.row_index, min(d.row_id) AS row_id, TRUE AS found FROM w JOIN d USING (http_method, dec) GROUP BY 1""")
def first_occurrences(t):
    """Row of the first occurrence of each wanted (method, decoded text) key."""
    d = t.flows.select("row_id", "http_method", X.decode(X.request_text()).alias("dec"))
    wanted = d.where(F.col("row_id") % 2 == 0).groupBy("http_method", "dec").agg(F.max("row_id").alias("row_index"))
    return dedup.first_occurrence(d, wanted, ["http_method", "dec"]).select("row_index", "row_id", "found")


@query("J8", f"""
    WITH d AS (SELECT *, {sql_decode(sql_text())} AS k FROM v_flows),
         s AS (SELECT k FROM d GROUP BY k HAVING bool_or(coalesce(attack_tool = 'custom', FALSE)) AND bool_or(coalesce(attack_tool = 'ffuf', FALSE)))
    SELECT row_id FROM d WHERE k NOT IN (SELECT k FROM s)""")
def drop_shared_payloads(t):
    key = X.decode(X.request_text())
    return membership.drop_shared_payloads(t.flows, key, "attack_tool", "custom", "ffuf").select("row_id")


@query("J10 X2 A7", f"""
    WITH s AS (SELECT conv_id, role, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'calib' ELSE 'test' END AS split
               FROM (SELECT *, {sql_unit("CAST(conv_id AS VARCHAR)")} AS u FROM conversations))
    SELECT split, count(*) AS n, count(DISTINCT conv_id) AS sessions, count(*) FILTER (role = 'user') AS users FROM s GROUP BY 1""")
def session_split_counts(t):
    """60/20/20 by session, joined back from the assignment table."""
    c = t.conversations.withColumn("session", F.col("conv_id").cast("string"))
    assignment = splits.session_split(c.select("session").distinct(), "session")
    return membership.assign(c, assignment, "session").groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("conv_id").alias("sessions"),
        F.count_if(F.col("role") == "user").alias("users"))


@query("J11 J12 A24", """
    WITH e AS (SELECT *, timestamp < '2024-01-21' AS early FROM v_flows), tr AS (SELECT DISTINCT url_path_raw FROM e WHERE early AND row_id % 3 = 0)
    SELECT e.url_path_raw AS site, count(*) AS n, min(timestamp) AS first_seen, bool_or(tr.url_path_raw IS NOT NULL) AS covered
    FROM e LEFT JOIN tr ON e.url_path_raw = tr.url_path_raw GROUP BY 1""")
def site_membership(t):
    f = t.flows.withColumnRenamed("url_path_raw", "site")
    train = f.where((F.col("timestamp") < "2024-01-21") & (F.col("row_id") % 3 == 0))
    first_seen = f.groupBy("site").agg(F.min("timestamp").alias("first_seen"))
    n = membership.mark_members(f, train, "site", "covered").groupBy("site").agg(
        F.count("*").alias("n"), F.bool_or("covered").alias("covered"))
    return n.join(first_seen, "site", "left")


@query("U1 U5", """
    SELECT DISTINCT label FROM (SELECT DISTINCT lang AS label FROM documents UNION ALL SELECT DISTINCT role FROM conversations)""")
def class_labels(t):
    return membership.class_labels(t.documents.select("lang"), t.conversations.select("role"))


@query("U1 A1", """
    SELECT y, source_id, count(*) AS n FROM (
      SELECT 0::INT AS y, source_id FROM v_docs WHERE label = 'benign' UNION ALL
      SELECT 1::INT, 'flows' FROM v_flows WHERE label = 'attack') GROUP BY 1, 2""")
def concatenated_classes(t):
    benign = t.posts.where(F.col("label") == "benign").select("row_id", "source_id")
    attack = t.flows.where(F.col("label") == "attack").select("row_id", F.lit("flows").alias("source_id"))
    return membership.concat_classes(benign, attack).groupBy("y", "source_id").agg(F.count("*").alias("n"))


@query("U3", f"""
    SELECT url_path_raw FROM v_flows GROUP BY 1 HAVING count(DISTINCT label) > 1""")
def overlapping_keys(t):
    """Paths that occur with more than one label, all pairs at once."""
    return membership.overlaps(t.flows, "url_path_raw", "label")


@query("U4", """
    SELECT DISTINCT url_path_raw FROM v_flows WHERE label = 'attack' EXCEPT SELECT url_path_raw FROM v_flows WHERE label = 'benign'""")
def missing_keys(t):
    return membership.missing_keys(t.flows.where("label = 'attack'"), t.flows.where("label = 'benign'"), ["url_path_raw"])


# --- splits ----------------------------------------------------------------------------------

def _sql_slices(early: str, late: str, calib: str, train: int, test: int, calib_first: bool = True) -> str:
    """Roles from ranks of a seeded shuffle over CTEs ``early`` and ``late`` with column ``sig``."""
    rank = f"row_number() OVER (ORDER BY {sql_place('sig')}, row_id)"
    if calib_first:
        role = f"CASE WHEN rn <= {calib} THEN 'calib' WHEN rn <= {calib} + {train} THEN 'train' END"
    else:
        role = f"CASE WHEN rn <= {train} THEN 'train' WHEN rn <= {train} + {calib} THEN 'calib' END"
    return f"""
      SELECT row_id, role FROM (SELECT row_id, {role} AS role FROM (
        SELECT row_id, {rank} AS rn, count(*) OVER () AS n FROM {early})) WHERE role IS NOT NULL
      UNION ALL SELECT row_id, 'test' FROM (SELECT row_id, {rank} AS rn FROM {late}) WHERE rn <= {test}"""


SQL_UNIQUE = f"""
    q AS (SELECT min(row_id) AS row_id FROM v_flows GROUP BY {SQL_SIG}),
    uf AS (SELECT row_id, {SQL_SIG} AS sig, url_path_raw, label, epoch_us(strptime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ')) AS us
           FROM v_flows JOIN q USING (row_id))"""
SQL_SHARE = "greatest(1, CAST(floor(n * 0.15) AS BIGINT))"


@query("X4 A14 T4 T3", f"""
    WITH {SQL_UNIQUE}, b AS (SELECT quantile_cont(CAST(us AS DOUBLE), 0.7) AS b FROM uf),
      early AS (SELECT * FROM uf WHERE us < (SELECT b FROM b)), late AS (SELECT * FROM uf WHERE us >= (SELECT b FROM b))
    {_sql_slices('early', 'late', SQL_SHARE, 120_000, splits.ALL_ROWS)}""")
def temporal_split(t):
    return splits.temporal_split(t.flows).select("row_id", "role")


@query("X5", f"""
    WITH {SQL_UNIQUE}, b AS (SELECT quantile_cont(CAST(us AS DOUBLE), 0.7) AS b FROM uf),
      early AS (SELECT * FROM uf WHERE us < (SELECT b FROM b)), late AS (SELECT * FROM uf WHERE us >= (SELECT b FROM b))
    {_sql_slices('early', 'late', str(splits.ALL_ROWS), 900, splits.ALL_ROWS, False)}""")
def temporal_split_train_first(t):
    """The single-domain order: train up to its bound, all other early rows calibrate, all late rows test."""
    return splits.temporal_split(t.flows, sizes=splits.SliceSizes(900, calib_share=None, calib_first=False)).select("row_id", "role")


@query("X6", f"""
    WITH {SQL_UNIQUE}, early AS (SELECT * FROM uf WHERE {sql_bucket('sig', 100)} < 70),
      late AS (SELECT * FROM uf WHERE {sql_bucket('sig', 100)} >= 70)
    {_sql_slices('early', 'late', SQL_SHARE, 120_000, splits.ALL_ROWS)}""")
def hash_control_split(t):
    return splits.hash_split(t.flows).select("row_id", "role")


@query("X7 A15 T9 F11", f"""
    WITH {SQL_UNIQUE}, b AS (SELECT url_path_raw, quantile_cont(CAST(us AS DOUBLE), 0.7) AS b, count(*) AS n FROM uf GROUP BY 1),
      e AS (SELECT uf.*, b.n < 10 OR us < b.b AS is_early FROM uf JOIN b USING (url_path_raw)),
      early AS (SELECT * FROM e WHERE is_early), late AS (SELECT * FROM e WHERE NOT is_early)
    {_sql_slices('early', 'late', SQL_SHARE, 120_000, splits.ALL_ROWS)}""")
def site_stratified_split(t):
    unique = splits.with_time(dedup.keep_first(t.flows)).withColumn("site", F.col("url_path_raw"))
    return splits.site_stratified_split(unique).select("row_id", "role")


@query("X8", f"""
    SELECT row_id, CASE WHEN u < 0.7 THEN 'fit' WHEN u < 0.85 THEN 'calib' ELSE 'test' END AS role FROM (
      SELECT row_id, {sql_unit("coalesce(attack_family, '') || '|' || url_path_raw || '|' || url_query || '|' || request_body")} AS u
      FROM v_flows WHERE label = 'attack')""")
def payload_split(t):
    return splits.payload_split(t.flows.where(F.col("label") == "attack")).select("row_id", "role")


@query("X9 T5 F11", f"""
    WITH a AS (SELECT row_id, CASE WHEN attack_tool IN ('ffuf', 'sqlmap') THEN 'A' WHEN attack_tool = 'custom' THEN 'B' END AS side
               FROM v_flows WHERE attack_family = 'sqli'),
      k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY {sql_place('CAST(row_id AS VARCHAR)')}) AS rn,
                   count(*) OVER (PARTITION BY side) AS n FROM a)
    SELECT row_id, direction, role FROM (
      SELECT row_id, side || '_to_' || CASE WHEN side = 'A' THEN 'B' ELSE 'A' END AS direction,
             CASE WHEN rn <= greatest(20, floor(n * 0.2)) THEN 'calib' ELSE 'fit' END AS role FROM k
      UNION ALL SELECT row_id, CASE WHEN side = 'A' THEN 'B' ELSE 'A' END || '_to_' || side, 'heldout' FROM k)
    WHERE (SELECT count(*) FROM a WHERE side = 'A') >= 40 AND (SELECT count(*) FROM a WHERE side = 'B') >= 40""")
def tool_holdout_split(t):
    return splits.tool_holdout(t.flows.where(F.col("attack_family") == "sqli"), ["ffuf", "sqlmap"], "custom").select(
        "row_id", "direction", "role")


FOLDS = [splits.Fold("src0", "src1"), splits.Fold("src2", "src3"), splits.Fold("src4", "src1", "en")]
FOLD_SIZES = splits.FoldSizes(20, 6)


def _sql_folds(sizes: splits.FoldSizes) -> str:
    pools = []
    for f in FOLDS:
        own = f"source_id = '{f.attack}'"
        attack = own if f.tool is None else f"{own} AND attack_tool = '{f.tool}'"
        extra = "" if f.tool is None else (
            f"WHEN {own} AND label = 'attack' THEN 'attack' WHEN {own} AND label = 'benign' THEN 'benign' ")
        pools.append(f"""SELECT *, '{f.name}' AS fold, CASE
            WHEN label = 'benign' AND source_id = '{f.benign}' THEN 'heldout_benign'
            WHEN label = 'attack' AND {attack} THEN 'heldout_attack' {extra}
            WHEN source_id NOT IN ('{f.benign}', '{f.attack}') THEN label END AS pool FROM d""")
    caps = (f"CASE pool WHEN 'benign' THEN {sizes.benign_per_source} WHEN 'attack' THEN {sizes.attack_per_source} "
            f"WHEN 'heldout_benign' THEN {sizes.heldout_benign} ELSE {sizes.heldout_attack} END")
    unit = sql_unit("'calib|' || source_id || '|' || CAST(row_id AS VARCHAR)")
    place = sql_place("source_id || '|' || CAST(row_id AS VARCHAR)")
    return f"""
    WITH d AS (SELECT *, {SQL_SIG} AS sig FROM v_docs), p AS ({' UNION ALL '.join(pools)}),
      r AS (SELECT *, row_number() OVER (PARTITION BY fold, pool, source_id ORDER BY {place}) AS rn FROM p WHERE pool IS NOT NULL),
      x AS (SELECT fold, row_id, source_id, label, sig, CASE WHEN pool LIKE 'heldout%' THEN pool
              WHEN (pool = 'attack' OR nature = 'real') AND {unit} < {sizes.calib_share} THEN 'calib' ELSE 'fit' END AS role
            FROM r WHERE rn <= {caps})
    SELECT fold, role, label, source_id, row_id FROM x
    WHERE role NOT LIKE 'heldout%' OR NOT EXISTS (
      SELECT 1 FROM x y WHERE y.fold = x.fold AND y.sig = x.sig AND y.role NOT LIKE 'heldout%')"""


@query("X10 J4 T3 T5", _sql_folds(FOLD_SIZES))
def leave_one_source_out(t):
    """All folds in one table; training is bounded per source, held-out sets are whole."""
    return splits.leave_one_source_out(t.posts, FOLDS, FOLD_SIZES).drop("signature_key")


@query("X11 X2", f"""
    WITH {SQL_UNIQUE} SELECT row_id, CASE WHEN {sql_unit('sig')} < 0.7 THEN 'train' ELSE 'calib' END AS role FROM uf""")
def benign_hash_split(t):
    return splits.benign_split(t.flows).select("row_id", "role")


@query("X12 T3", f"""
    WITH a AS (SELECT row_id, {SQL_SIG} AS sig FROM v_docs WHERE label = 'attack'),
      h AS (SELECT *, {sql_bucket('sig', 10)} < 7 AS tr FROM a)
    SELECT row_id, CASE WHEN tr THEN 'train' ELSE 'test' END AS role FROM h
    UNION ALL SELECT -1 - row_id, CASE WHEN attack_tool = 'custom' THEN 'tool_test' ELSE 'train' END FROM v_flows WHERE label = 'attack'""")
def attack_pools(t):
    """Hashed pools of unique attack texts plus a second source with one tool held out."""
    main = dedup.keep_first(t.posts.where(F.col("label") == "attack"))
    other = t.flows.where(F.col("label") == "attack").withColumn("row_id", -1 - F.col("row_id"))
    return splits.attack_pools(main, other, train_cap=None).select("row_id", "role")


@query("X3 A6", f"""
    WITH s AS (SELECT 's' || CAST(user_id AS VARCHAR) AS session_id, user_id, label, attack_family, attack_tool, row_id FROM v_flows),
      g AS (SELECT session_id, arg_min(label, row_id) AS label, max(attack_family) AS fam, arg_min(attack_tool, row_id) AS tool FROM s GROUP BY 1),
      u AS (SELECT *, {sql_unit('session_id')} AS u, row_number() OVER (PARTITION BY fam ORDER BY session_id) - 1 AS rk,
                   count(*) OVER (PARTITION BY fam) AS n FROM g)
    SELECT session_id, CASE
      WHEN label = 'benign' THEN CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'calib' ELSE 'test' END
      WHEN fam = 'brute_force' THEN CASE WHEN rk < round_even(n * 0.6, 0) THEN 'train'
            WHEN rk < round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'calib' ELSE 'test' END
      WHEN fam = 'bola_idor' THEN 'train'
      WHEN tool = 'custom' THEN 'test' ELSE 'train' END AS split FROM u""")
def stratified_session_split(t):
    f = t.flows.withColumn("session_id", F.concat(F.lit("s"), F.col("user_id").cast("string")))
    return splits.stratified_session_split(f)


# --- quality checks --------------------------------------------------------------------------

@query("Q1 Q3 Q4 Q9 A26 F10", f"""
    WITH {SQL_MATCHED}, a AS (SELECT count(*) FILTER (label = 'attack') AS atk, count(*) FILTER (label = 'benign') AS ben,
        count(*) FILTER (label = 'attack' AND response_status IS NOT NULL) AS got,
        count(*) FILTER (label = 'benign' AND {sql_rule(sql_text(), rules.INJECTION_MARKERS)}) AS marked FROM lab)
    SELECT check_name, ok, round(measured, 6) AS measured FROM (
      SELECT unnest(['zero_null_label', 'zero_null_label_source', 'session_id_present', 'label_source_names_campaign',
               'benign_no_injection_markers', 'attack_delivery', 'benign_ge_attack']) AS check_name,
             unnest([TRUE, TRUE, TRUE, TRUE, marked = 0, got / atk >= 0.95, ben >= atk]) AS ok,
             unnest([0.0::DOUBLE, 0.0, 0.0, 0.0, CAST(marked AS DOUBLE), got / atk, CAST(ben - atk AS DOUBLE)]) AS measured FROM a)""")
def corpus_row_checks(t):
    return quality.row_checks(_labelled(t)).withColumn("measured", F.round("measured", 6))


@query("Q2", f"""
    WITH {SQL_MATCHED} SELECT 'benign_purity' AS check_name, count(*) = 0 AS ok, CAST(count(*) AS DOUBLE) AS measured
    FROM lab l WHERE l.label = 'benign' AND EXISTS (SELECT 1 FROM v_campaigns c WHERE c.label = 'attack'
      AND c.src_ip = l.src_ip AND l.timestamp >= c.start_ts AND l.timestamp <= c.end_ts)""")
def benign_purity_check(t):
    labelled = _labelled(t).drop("attack_family", "attack_tool", "campaign_id", "label_source")
    return quality.benign_purity(labelled, t.campaigns)


SQL_WINDOWS = """
    w AS (SELECT attack_family, count(DISTINCT (src_ip, epoch(strptime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ'))::BIGINT)) AS x FROM v_flows GROUP BY 1),
    v AS (SELECT attack_family, count(*) AS n, count(DISTINCT attack_tool) AS tools FROM v_flows WHERE label = 'attack' GROUP BY 1),
    s AS (SELECT attack_family, count(DISTINCT (src_ip, epoch_us(strptime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ')) // 10000000)) AS windows
          FROM v_flows WHERE label = 'attack' GROUP BY 1)"""


@query("Q5 Q6 Q7 A8 A9 P31", f"""
    WITH {SQL_WINDOWS}
    SELECT 'content_' || attack_family AS check_name, tools >= 2 AND n >= 500 AS ok, CAST(n AS DOUBLE) AS measured FROM v
      WHERE attack_family IN ('sqli', 'xss', 'path_traversal')
    UNION ALL SELECT 'behavioural_' || attack_family, windows >= 50, CAST(windows AS DOUBLE) FROM s WHERE attack_family = 'brute_force'
    UNION ALL SELECT 'context_' || f, coalesce(n, 0) > 0, CAST(coalesce(n, 0) AS DOUBLE)
      FROM (SELECT unnest(['bola_idor', 'mass_assignment', 'business_logic_abuse']) AS f) c LEFT JOIN v ON v.attack_family = c.f""")
def corpus_family_checks(t):
    return quality.family_checks(t.flows.withColumn("session_id", F.col("src_ip")))


@query("A9", """
    SELECT attack_family, count(*) AS n, array_to_string(list_sort(list(DISTINCT attack_tool)), ',') AS tools
    FROM v_flows WHERE label = 'attack' GROUP BY 1""")
def family_volume(t):
    return quality.family_volume(t.flows).withColumn("tools", F.array_join("tools", ","))


@query("Q8 U3", f"""
    SELECT 'session_split_disjoint' AS check_name, count(*) = 0 AS ok, CAST(count(*) AS DOUBLE) AS measured FROM (
      SELECT conv_id FROM (SELECT conv_id, CASE WHEN {sql_unit("CAST(conv_id AS VARCHAR)")} < 0.6 THEN 1 ELSE 2 END AS s FROM conversations)
      GROUP BY 1 HAVING count(DISTINCT s) > 1)""")
def split_disjointness_check(t):
    c = t.conversations.withColumn("session_id", F.col("conv_id").cast("string"))
    return quality.split_disjoint(splits.session_split(c))


@query("Q10", """
    SELECT l.source_id, l.n = coalesce(o.n, 0) AND l.ben = coalesce(o.ben, 0) AS ok, o.n AS rows_found, o.ben AS benign_found
    FROM (SELECT source_id, count(*) AS n, count(*) FILTER (label = 'benign' AND row_id % 50 <> 0) AS ben FROM v_docs GROUP BY 1) l
    LEFT JOIN (SELECT source_id, count(*) AS n, count(*) FILTER (label = 'benign') AS ben FROM v_docs GROUP BY 1) o USING (source_id)""")
def expected_count_check(t):
    """Counts per source against an expectation table that is off for some sources."""
    benign = (F.col("label") == "benign")
    expected = t.posts.groupBy("source_id").agg(
        F.count("*").alias("rows"), F.count_if(benign & (F.col("row_id") % 50 != 0)).alias("benign"))
    return quality.expected_counts(t.posts, expected)


@query("Q11", """
    WITH e AS (SELECT lang || '/' || source AS path, avg(n_chars) AS v FROM documents GROUP BY 1),
         g AS (SELECT lang || '/' || source AS path, avg(CASE WHEN doc_id % 97 = 0 THEN n_chars + 1 ELSE n_chars END) AS v
               FROM documents WHERE source <> 'src5' GROUP BY 1)
    SELECT coalesce(e.path, g.path) AS path, CASE WHEN g.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unexpected' ELSE 'value' END AS difference,
           round(e.v, 6) AS expected, round(g.v, 6) AS got
    FROM e FULL OUTER JOIN g ON e.path = g.path WHERE e.path IS NULL OR g.path IS NULL OR abs(e.v - g.v) > 1e-6""")
def metric_differences(t):
    """Two metric tables compared path by path within a tolerance."""
    path = F.concat_ws("/", "lang", "source")
    none = F.lit(None).cast("string").alias("str")
    expected = t.documents.groupBy(path.alias("path")).agg(F.avg("n_chars").alias("value")).select("path", "value", none)
    shifted = F.when(F.col("doc_id") % 97 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = t.documents.where(F.col("source") != "src5").groupBy(path.alias("path")).agg(
        F.avg(shifted).alias("value")).select("path", "value", none)
    return quality.metric_differences(expected, got).withColumns(
        {"expected": F.round("expected", 6), "got": F.round("got", 6)})


@query("Q12", f"""
    SELECT row_id AS row_index FROM v_flows WHERE {sql_decode(sql_text())} <> {sql_decode(sql_text(), 1)}""")
def decode_round_trip(t):
    """Rows whose decoded text is not what a single pass gives."""
    f = t.flows.withColumnRenamed("row_id", "row_index")
    once = f.select("row_index", X.decode(X.request_text(), 1).alias("dec"))
    return quality.decode_mismatches(f, once)


@query("A22 W14", f"""
    WITH d AS (SELECT *, {sql_any_rule(sql_decode(sql_text()))} AS marked FROM v_flows WHERE label = 'attack')
    SELECT attack_family, count(*) AS n, count(*) FILTER (marked) AS marked, count(*) FILTER (NOT marked) AS marker_free FROM d GROUP BY 1""")
def marked_by_family(t):
    d = t.flows.where(F.col("label") == "attack").withColumn("_m", rules.any_rule(X.decode(X.request_text())))
    return d.groupBy("attack_family").agg(F.count("*").alias("n"), F.count_if("_m").alias("marked"),
                                          F.count_if(~F.col("_m")).alias("marker_free"))


@query("T6 W14", f"""
    WITH d AS (SELECT row_id, attack_family, {sql_any_rule(sql_decode(sql_text()))} AS marked FROM v_flows WHERE label = 'attack'),
      mf AS (SELECT * FROM d WHERE NOT marked),
      q AS (SELECT attack_family, CAST(round_even(count(*) / sum(count(*)) OVER () * 100, 0) AS BIGINT) AS q,
                   row_number() OVER (ORDER BY count(*) DESC, attack_family) AS r FROM mf GROUP BY 1),
      k AS (SELECT attack_family, q + CASE WHEN r = 1 THEN 100 - sum(q) OVER () ELSE 0 END AS quota FROM q),
      s AS (SELECT mf.*, row_number() OVER (PARTITION BY attack_family ORDER BY {sql_place('CAST(row_id AS VARCHAR)')}) AS rn FROM mf)
    SELECT row_id, attack_family FROM s JOIN k USING (attack_family) WHERE rn <= quota""")
def marker_free_sample(t):
    """100 attacks no rule fires on, by family in proportion."""
    from wiretally.plans.jobs import marker_free_sample
    return marker_free_sample(t.flows.where(F.col("label") == "attack")).select("row_id", "attack_family")


@query("T7", f"""
    WITH d AS (SELECT attack_family, {sql_decode(sql_text())} AS payload, min(row_id) AS row_id FROM v_flows WHERE label = 'attack' GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY attack_family ORDER BY row_id) AS rn FROM d)
    SELECT attack_family, payload, row_id FROM r WHERE rn <= 40""")
def first_payloads(t):
    """The first 40 different decoded payloads per family."""
    d = t.flows.where(F.col("label") == "attack").select("row_id", "attack_family", X.decode(X.request_text()).alias("payload"))
    return ranking.first_distinct(d, "payload", "attack_family", 40)


@query("T8 S6", """
    SELECT row_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY row_id) AS rn FROM v_docs) WHERE rn <= 25""")
def prefix_per_source(t):
    """The row cap of an ingest: the first rows of each source."""
    return ranking.prefix(t.posts, 25, by=["source_id"]).select("row_id", "source_id")


@query("T3", f"""
    SELECT row_id FROM v_flows ORDER BY {sql_place("CAST(row_id AS VARCHAR)")} LIMIT 777""")
def seeded_sample(t):
    return ranking.seeded_sample(t.flows, 777, "row_id").select("row_id")


@query("T5", f"""
    SELECT sampled, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM (
      SELECT row_id, {sql_unit('CAST(row_id AS VARCHAR)')} < 0.15 AS sampled FROM v_flows) GROUP BY 1""")
def fraction_and_rest(t):
    return ranking.fraction(t.flows, 0.15, "row_id").groupBy("sampled").agg(
        F.count("*").alias("n"), F.sum("row_id").alias("ids"))
