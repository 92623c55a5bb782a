"""Readers and streams: the tables are written out in each format by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.catalog.corpus_queries import SQL_MATCHED
from wiretally.catalog.registry import query
from wiretally.catalog.text_queries import LABEL_RULES, SQL_SIG
from wiretally.operators import dedup, labelling
from wiretally.plans import detector as D
from wiretally.schema import CAPTURE_SCHEMA, conform
from wiretally.session import scratch_path
from wiretally.sources import lines, logs, sinks, tables
from wiretally.streaming import flows as streams


QUICK = D.Settings(text_iterations=15)


def _target():
    return F.concat("url_path_raw", F.lit("?"), "url_query")


def _text_file(t, line, name: str, **options) -> str:
    path = scratch_path(t.spark, name)
    line.write.options(**options).text(path)
    return path


def _clf(ts: str = "timestamp"):
    return F.concat(F.date_format(F.to_timestamp(ts), "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0330"))


def _access_lines(t):
    """Flows as combined log lines; every ninety-seventh line is broken."""
    good = F.concat(F.col("src_ip"), F.lit(" - - ["), _clf(), F.lit('] "'), F.col("http_method"), F.lit(" "), _target(),
                    F.lit(' HTTP/1.1" '), F.coalesce(F.col("response_status").cast("string"), F.lit("500")), F.lit(" "),
                    F.when(F.col("row_id") % 3 == 0, "-").otherwise(F.col("row_id").cast("string")),
                    F.lit(' "http://r/'), F.col("user_id").cast("string"), F.lit('" "agent/x"'))
    return t.flows.select(F.when(F.col("row_id") % 97 == 0, F.concat(F.lit("garbage "), _target())).otherwise(good).alias("value"))


@query("S1 P2 P9 P12 P15", f"""
    SELECT strftime(strptime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ'), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS timestamp, src_ip, http_method,
      url_path_raw, url_query, '1.1' AS http_version, '{{"User-Agent":"agent/x","Referer":"http://r/' || CAST(user_id AS VARCHAR) || '"}}' AS headers,
      CAST(coalesce(response_status, 500) AS BIGINT) AS response_status, CASE WHEN row_id % 3 = 0 THEN 0 ELSE row_id END AS response_size,
      'zanbil:ip:' || src_ip AS session_id, 'benign' AS label FROM v_flows WHERE row_id % 97 <> 0""")
def read_access_log(t):
    path = _text_file(t, _access_lines(t), "access")
    return logs.access_log(t.spark, path).select(
        "timestamp", "src_ip", "http_method", "url_path_raw", "url_query", "http_version", "headers", "response_status",
        "response_size", "session_id", "label")


@query("S1 K6", """
    SELECT count(*) AS source_lines, count(*) FILTER (row_id % 97 <> 0) AS parsed_rows, count(*) FILTER (row_id % 97 = 0) AS parse_errors,
           round(count(*) FILTER (row_id % 97 = 0) / count(*), 6) AS parse_error_rate FROM v_flows""")
def access_log_statistics(t):
    path = _text_file(t, _access_lines(t), "access")
    stats = lines.ingest_stats(logs.parse_access_lines(lines.read_lines(t.spark, path, numbered=False)))
    out = scratch_path(t.spark, "stats")
    sinks.write_stats(stats, out)
    return t.spark.read.schema(stats.schema).json(out)


@query("S4 P3 D1 T8", f"""
    SELECT DISTINCT http_method, url_path_raw, url_query, 'nasa' AS source_id FROM v_flows""")
def read_archive_log(t):
    """Gzipped common log."""
    line = F.concat(F.lit("host - - [x] \""), "http_method", F.lit(" "), F.ltrim(_target(), F.lit("/")), F.lit(' HTTP/1.0" 200 1'))
    path = _text_file(t, t.flows.select(line.alias("value")), "archive", compression="gzip")
    return logs.archive_log(t.spark, path, "nasa", None).select("http_method", "url_path_raw", "url_query", "source_id")


@query("S7 J9 K8 P18", """
    WITH l AS (SELECT *, lower(http_method || ' ' || url_path_raw || '?' || url_query) AS line FROM v_flows),
      r AS (SELECT http_method, url_path_raw, url_query, CASE WHEN contains(line, 'etc') AND contains(line, 'passwd') THEN 'probe'
                   WHEN contains(line, '3cscript') THEN 'markup' WHEN contains(line, 'signup') AND contains(line, 'k=1') THEN 'login' ELSE 'benign' END AS gt_rule FROM l)
    SELECT DISTINCT http_method, url_path_raw, url_query, gt_rule, CASE WHEN gt_rule = 'benign' THEN 'benign' ELSE 'attack' END AS label FROM r""")
def read_host_log(t):
    """Multi-tenant log labelled by the ordered rules, unique requests."""
    line = F.concat(F.lit("shop.example - - ["), _clf(), F.lit('] "'), "http_method", F.lit(" "), _target(), F.lit(' HTTP/1.1" 200 7 "r" "u"'))
    path = _text_file(t, t.flows.select(line.alias("value")), "host")
    return logs.host_log(t.spark, path, LABEL_RULES).select("http_method", "url_path_raw", "url_query", "gt_rule", "label")


@query("S5", """
    SELECT DISTINCT http_method, url_path_raw, url_query, '{"Host":"h:80","X-Id":"' || CASE WHEN http_method = 'POST' THEN CAST(user_id AS VARCHAR) ELSE '0' END || '"}' AS headers,
           CASE WHEN http_method = 'POST' THEN 'a=1' || chr(10) || chr(10) || 'u=' || CAST(user_id AS VARCHAR) ELSE '' END AS request_body FROM v_flows""")
def read_audit_log(t):
    """Multipart audit log: section B of every transaction."""
    mark = lambda s: F.concat(F.lit("--"), F.substring(F.md5(F.col("row_id").cast("string")), 1, 8), F.lit(f"-{s}--\n"))
    user = F.col("user_id").cast("string")
    body = F.when(F.col("http_method") == "POST", F.concat(F.lit("a=1\n\nu="), user, F.lit("\n"))).otherwise(F.lit(""))
    shown = F.when(F.col("http_method") == "POST", user).otherwise("0")
    record = F.concat(mark("A"), F.lit("[stamp] x\n"), mark("B"), "http_method", F.lit(" "), _target(),
                      F.lit(" HTTP/1.1\nHost: h:80\nX-Id: old\nX-Id: "), shown, F.lit("\n\n"), body, mark("F"), F.lit("HTTP/1.1 403\n"),
                      F.rtrim(mark("Z"), F.lit("\n")))
    path = _text_file(t, t.flows.select(record.alias("value")), "audit")
    rows = logs.audit_log(t.spark, path)
    return rows.select("http_method", "url_path_raw", "url_query", "headers", "request_body")


@query("S2 P8 P10 P13", """
    SELECT strftime(strptime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') - INTERVAL 210 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS timestamp, src_ip,
      CASE WHEN user_id % 2 = 0 THEN user_id ELSE 0 END AS src_port, url_path_raw, url_query,
      CASE WHEN user_id % 3 = 0 THEN '{"host":"h"}' ELSE '{"user-agent":"a,\\"b\\"","host":"h"}' END AS headers,
      'x' || chr(10) || CAST(row_id AS VARCHAR) AS request_body, CASE WHEN label = 'benign' THEN 'benign' ELSE 'attack' END AS label,
      CAST(response_status AS BIGINT) AS response_status FROM v_flows""")
def read_honeypot_csv(t):
    """Multi-line CSV with quoted cells; header columns folded into one object."""
    blank = F.lit("")
    cells = {
        "timestamp": _clf(), "src_ip": F.col("src_ip"),
        "src_port": F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("n/a"),
        "request_http_method": F.col("http_method"), "request_http_request": _target(), "request_http_protocol": F.lit("HTTP/1.1"),
        "request_body": F.concat(F.lit("x\n"), F.col("row_id").cast("string")),
        "response_http_status_code": F.coalesce(F.col("response_status").cast("string"), blank),
        "response_content_length": F.lit("10"), tables.NORMAL_COLUMN: F.when(F.col("label") == "benign", "1").otherwise("0")}
    cells |= {c: blank for c in tables.HONEYPOT_HEADERS}
    cells |= {"request_user_agent": F.when(F.col("user_id") % 3 == 0, "").otherwise('a,"b"'), "request_host": F.lit("h")}
    path = scratch_path(t.spark, "honeypot")
    t.flows.select(*[c.alias(n) for n, c in cells.items()]).write.csv(path, header=True, escape='"', quoteAll=True)
    return tables.honeypot_csv(t.spark, path).select(
        "timestamp", "src_ip", "src_port", "url_path_raw", "url_query", "headers", "request_body", "label", "response_status")


@query("S3", """
    SELECT DISTINCT http_method, url_path_raw, url_query, CASE WHEN http_method = 'GET' THEN 'benign' ELSE 'attack' END AS label FROM v_flows""")
def read_semi_synthetic_csv(t):
    url = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("http://h:8080"), _target())).otherwise(_target())
    path = scratch_path(t.spark, "csic")
    t.flows.select(F.col("http_method").alias("Method"), F.concat(url, F.lit(" HTTP/1.1")).alias("URL"), F.lit("ua").alias("User-Agent"),
                   F.when(F.col("http_method") == "GET", "0").otherwise("1").alias("classification")).write.csv(path, header=True, escape='"')
    return tables.semi_synthetic_csv(t.spark, path).select("http_method", "url_path_raw", "url_query", "label")


@query("S6 P11 P12", """
    SELECT min(strftime(o_orderdate, '%Y-%m-%d') || 'T01:02:03.000Z') IS NOT NULL AS dated, '/Archives/edgar/data/' || CAST(CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE o_custkey END AS VARCHAR)
      || '/' || o_orderpriority || '.htm' AS url_path_raw FROM orders GROUP BY 2""")
def read_filing_csv(t):
    """Filing-server export written from orders; a bad id becomes 0."""
    path = scratch_path(t.spark, "filing")
    t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("01:02:03").alias("time"),
                    F.when(F.col("o_custkey") % 10 == 0, "bad").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("cik"),
                    F.col("o_orderpriority").alias("accession"), F.lit(".htm").alias("extention"), F.lit("200").alias("code")
                    ).write.csv(path, header=True)
    return tables.filing_csv(t.spark, path).select((F.length("timestamp") == 24).alias("dated"), "url_path_raw")


def _capture_files(t) -> tuple[str, str]:
    captures, manifests = scratch_path(t.spark, "capture"), scratch_path(t.spark, "manifests")
    rows = t.flows.drop("label", "attack_family", "attack_tool").withColumn("capture_id", F.col("row_id").cast("string"))
    conform(rows, CAPTURE_SCHEMA).write.json(captures)
    t.campaigns.drop("ord").write.parquet(manifests)
    return captures, manifests


@query("S8", """
    SELECT campaign_id, app, label, src_ip, start_ts, end_ts, TRUE AS placed FROM v_campaigns WHERE campaign_id NOT LIKE 'c%'""")
def read_manifests(t):
    """Campaigns of whole sources, one multi-line JSON file each; every one gets a place from its own file name."""
    path = scratch_path(t.spark, "manifests")
    whole = t.campaigns.where("campaign_id NOT LIKE 'c%'").select("campaign_id", "app", "label", "attack_family", "attack_tool", "src_ip", "start_ts", "end_ts")
    whole.write.option("maxRecordsPerFile", 1).json(path)
    rows = tables.manifests(t.spark, path)
    alone = rows.groupBy("ord").agg(F.count("*").alias("_n"))
    return rows.join(alone, "ord").select("campaign_id", "app", "label", "src_ip", "start_ts", "end_ts", (F.col("_n") == 1).alias("placed"))


@query("S9 U2", f"""
    WITH {SQL_MATCHED}, k AS (SELECT row_id % 97 = 0 AS torn, row_id % 89 = 0 AS undated, row_id FROM v_flows)
    SELECT CASE WHEN torn THEN 'torn' WHEN undated THEN 'no timestamp' WHEN lab.row_id IS NULL THEN 'unmatched' ELSE lab.label END AS outcome, count(*) AS n,
           sum(k.row_id)::BIGINT AS ids
    FROM k LEFT JOIN lab USING (row_id) GROUP BY 1""")
def read_captures(t):
    """Two capture files read together and labelled; torn and undated lines are kept aside and counted."""
    path = scratch_path(t.spark, "capture")
    rows = t.flows.drop("label", "attack_family", "attack_tool").withColumns({
        "capture_id": F.col("row_id").cast("string"), "timestamp": F.when(F.col("row_id") % 89 == 0, "never").otherwise(F.col("timestamp"))})
    line = F.to_json(F.struct(*conform(rows, CAPTURE_SCHEMA).columns))
    lines_ = conform(rows, CAPTURE_SCHEMA).select(
        F.when(F.col("capture_id").cast("long") % 97 == 0, F.concat(F.lit('{"capture_id":"'), "capture_id", F.lit('","timest'))).otherwise(line).alias("value"),
        (F.col("capture_id").cast("long") % 2).alias("part"))
    for part in (0, 1):
        lines_.where(F.col("part") == part).select("value").write.text(f"{path}/{part}")
    good, rejected = tables.capture_lines(t.spark, [f"{path}/0", f"{path}/1"])
    matched = labelling.match_campaigns(good, t.campaigns).select(F.coalesce("match.label", F.lit("unmatched")).alias("outcome"), F.col("capture_id").cast("long").alias("id"))
    aside = rejected.select(F.col("reason").alias("outcome"), F.regexp_extract("line", r'"capture_id":"(\d+)"', 1).cast("long").alias("id"))
    return matched.unionByName(aside).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("S9 J1", f"""
    WITH {SQL_MATCHED} SELECT CAST(row_id AS VARCHAR) AS capture_id, session_id, label, campaign_id FROM lab""")
def label_capture_stream(t):
    """Capture lines labelled as a stream."""
    captures, campaigns = _capture_files(t)
    out, state = scratch_path(t.spark, "labelled"), scratch_path(t.spark, "labelled-state")
    streams.label_batches(streams.capture_stream(t.spark, captures), lambda: _stored_campaigns(t, campaigns), out, state,
                          columns=["capture_id", "session_id", "label", "campaign_id"]).awaitTermination()
    return streams.committed(t.spark, out)


def _stored_campaigns(t, path: str):
    return t.spark.read.parquet(path).withColumn("ord", F.col("campaign_id"))


@query("R1 S9 J1 K7 M7 M14", f"""
    WITH {SQL_MATCHED} SELECT label, count(*) AS n, count(*) AS equal_scores, TRUE AS later_campaigns_seen FROM lab GROUP BY 1""")
def score_capture_stream(t):
    """Capture lines labelled and scored as a stream by a stored model, in two runs: more lines and more campaigns arrive before the
    second one, which goes on from the checkpoint. Scores are held against those of the model over the same lines as a batch."""
    rows = dedup.keep_first(t.flows).withColumn("y", (F.col("label") == "attack").cast("int"))
    where = scratch_path(t.spark, "model")
    D.fit_text(rows, QUICK).save(where)
    model = D.TextModel.load(where)
    captures, campaigns, out, state = (scratch_path(t.spark, x) for x in ("capture", "manifests", "scored", "scored-state"))
    lines = conform(t.flows.drop("label", "attack_family", "attack_tool").withColumn("capture_id", F.col("row_id").cast("string")), CAPTURE_SCHEMA)
    late = F.pmod(F.xxhash64("src_ip"), F.lit(2)) == 1  # sources that come with the second run, campaigns and lines
    for part in (~late, late):
        t.campaigns.drop("ord").where(part).write.mode("append").parquet(campaigns)
        lines.where(part).write.mode("append").json(captures)
        streams.label_batches(streams.capture_stream(t.spark, captures), lambda: _stored_campaigns(t, campaigns), out, state, model.score,
                              ["capture_id", "src_ip", "label", "p_text"]).awaitTermination()
    once = model.score(conform(t.spark.read.schema(CAPTURE_SCHEMA).json(captures), CAPTURE_SCHEMA)).select("capture_id", F.col("p_text").alias("expected"))
    found = streams.committed(t.spark, out).withColumn("_late", late).join(once, "capture_id")
    return found.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.abs(F.col("p_text") - F.col("expected")) < 1e-12).alias("equal_scores"),
        F.bool_or("_late").alias("later_campaigns_seen"))


@query("R2 A8", """
    SELECT user_id, CAST(floor(epoch(ts) / 10) * 10 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_window_counts(t):
    """Events per user and ten seconds, counted as a stream."""
    counts = streams.session_window_counts(_event_stream(t), ["user_id"], delay="1 day")
    return streams.latest(t.spark, streams.run_to_end(counts, "windows", "update"), ["user_id", "window_start"])


def _event_stream(t):
    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("R3 D1", "SELECT event_type, user_id, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def stream_unique_requests(t):
    """Stream deduplication with a horizon longer than the table."""
    keyed = _event_stream(t).withColumn("http_method", F.col("event_type")).withColumn("url_path_raw", F.col("user_id").cast("string"))
    unique = streams.unique_requests(keyed, ["http_method", "url_path_raw"], horizon="60 days")
    rows = t.spark.read.parquet(streams.run_to_end(unique.select("event_type", "user_id"), "unique"))
    return rows.groupBy("event_type", "user_id").agg((F.count("*") == 1).alias("seen"))


@query("K1 K2 S10", """
    SELECT label AS split, count(*) AS n, count(DISTINCT src_ip) AS sources FROM v_flows GROUP BY 1""")
def written_splits(t):
    """Unified Parquet written per split and read back with two columns."""
    path = scratch_path(t.spark, "splits")
    sinks.write_splits(conform(t.flows).withColumn("split", F.col("label")), path)
    return tables.unified(t.spark, path, ["split", "src_ip"]).groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("src_ip").alias("sources"))


@query("S11 P19 D1", f"""
    SELECT source_id, nature, has_body, count(*) AS n FROM (
      SELECT 'flows' AS source_id, 'real' AS nature, FALSE AS has_body FROM v_flows GROUP BY {SQL_SIG}
      UNION ALL SELECT 'posts', 'testbed', TRUE FROM v_docs GROUP BY {SQL_SIG}) GROUP BY 1, 2, 3""")
def gathered_sources(t):
    """Sources of different columns under one model-input schema; one that is missing is skipped."""
    rows = tables.gather({
        "flows": lambda: tables.model_source(t.flows, "flows", "real", False),
        "absent": lambda: tables.unified(t.spark, f"{t.sf_dir}/absent.parquet"),
        "posts": lambda: tables.model_source(t.posts.drop("headers"), "posts", "testbed", True, "attack_tool")})
    return rows.groupBy("source_id", "nature", "has_body").agg(F.count("*").alias("n"))
