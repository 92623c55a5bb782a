"""Request-shaped views over the given tables, once as DataFrames and once as SQL.

They stand in for the traffic datasets: ``events`` become flows, ``pages`` and ``documents``
become requests with bodies, ``lineitem`` becomes a table of scores. Every row of a table takes
part; the payload texts are fixture values picked by key."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixture values: query payloads per family, and for everything else.
PAYLOADS = {
    "sqli": ["1%27%20or%20%271%27=%271", "1+union+select+name", "%2527%2520or%25201=1--%2520x",
             "1%27%20and%20slept"],
    "xss": ["%3Cscript%3Ealert(1)%3C/script%3E", "%253Csvg%2520onload%253D1%253E", "x%22onerror%3D1",
            "hello%3Cb%3E"],
    "path_traversal": ["../../etc/passwd", "%2e%2e%2fboot.ini", "%252e%252e%252fwin.ini", "..;/admin"],
}
WORDS = ["shoes", "red+shirt", "caf%C3%A9", "100%25", "size%3D42", "select+a+gift", "new%20in", "terms&page=2"]
FAMILIES = ["sqli", "xss", "path_traversal", "brute_force", "bola_idor"]
TOOLS = ["ffuf", "sqlmap", "custom"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


SQL_VIEWS = {
    "v_users": f"""
        SELECT *, user_id % 3 = 0 AS hostile, {_sql_list(FAMILIES)}[(user_id // 3) % 5 + 1] AS fam,
               {_sql_list(TOOLS)}[(user_id // 3) % 3 + 1] AS tl
        FROM events""",
    "v_flows": f"""
        SELECT event_id AS row_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
          '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS src_ip,
          CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS http_method,
          '/' || event_type || '/' || CAST(user_id % 40 AS VARCHAR) AS url_path_raw,
          'k=' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) || '&q=' ||
          CASE WHEN hostile AND fam = 'sqli' THEN {_sql_list(PAYLOADS['sqli'])}[event_id % 4 + 1]
               WHEN hostile AND fam = 'xss' THEN {_sql_list(PAYLOADS['xss'])}[event_id % 4 + 1]
               WHEN hostile AND fam = 'path_traversal' THEN {_sql_list(PAYLOADS['path_traversal'])}[event_id % 4 + 1]
               ELSE {_sql_list(WORDS)}[event_id % 8 + 1] END AS url_query,
          '' AS request_body,
          '{{"User-Agent":"agent/' || CAST(user_id % 7 AS VARCHAR) || '","'
            || CASE WHEN user_id % 2 = 0 THEN 'REFERER' ELSE 'referrer' END || '":"http://x/'
            || CAST(user_id % 5 AS VARCHAR) || '","authorization":"Bearer h.'
            || rtrim(translate(to_base64(encode('{{"sub":"u' || CAST(user_id AS VARCHAR) || '"}}')), '+/', '-_'), '=')
            || '.s"}}' AS headers,
          CASE WHEN event_type = 'error' THEN NULL ELSE 200 END AS response_status,
          CASE WHEN user_id % 2 = 0 THEN 'vampi' ELSE 'zanbil' END AS app,
          CASE WHEN hostile THEN 'attack' ELSE 'benign' END AS label,
          CASE WHEN hostile THEN fam END AS attack_family, CASE WHEN hostile THEN tl END AS attack_tool,
          user_id
        FROM v_users""",
    "v_campaigns": """
        SELECT campaign_id AS ord, campaign_id, app, label, attack_family, attack_tool, src_ip, start_ts, end_ts
        FROM (SELECT 'c_' || src_ip || '_' || substr(timestamp, 1, 10) AS campaign_id, app, label, attack_family,
                     attack_tool, src_ip, min(timestamp) AS start_ts, max(timestamp) AS end_ts
              FROM v_flows WHERE user_id % 7 <> 1 GROUP BY ALL
              UNION ALL
              SELECT CASE WHEN user_id % 10 = 0 THEN 'a_' ELSE 'z_' END || src_ip, app, 'benign', NULL, NULL,
                     src_ip, min(timestamp), max(timestamp)
              FROM v_flows WHERE user_id % 5 = 0 GROUP BY user_id, app, src_ip)""",
    "v_pages": """
        SELECT page_id AS row_id, CASE WHEN page_id % 4 = 0 THEN 'GET' ELSE 'POST' END AS http_method,
          regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
          regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS url_path_raw,
          regexp_extract(url, '[?]([^#]*)', 1) AS url_query, html AS request_body,
          '{"Host":"' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '","USER-AGENT":"crawler/'
            || CAST(page_id % 9 AS VARCHAR) || '","' || CASE WHEN page_id % 3 = 0 THEN 'Referrer'
            WHEN page_id % 3 = 1 THEN 'referer' ELSE 'x-from' END || '":"' || url || '"}' AS headers
        FROM pages""",
    "v_docs": """
        SELECT d.doc_id AS row_id, 'POST' AS http_method, '/' || lang || '/' || source AS url_path_raw,
          '' AS url_query, text AS request_body, '' AS headers, source AS source_id,
          CASE WHEN CAST(substr(source, 4) AS BIGINT) % 2 = 0 THEN 'real' ELSE 'synthetic' END AS nature,
          CASE WHEN toxic = 1 OR quality = 0 OR d.doc_id % 5 = 0 THEN 'attack' ELSE 'benign' END AS label,
          lang AS attack_tool
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_scores": """
        SELECT l_orderkey * 8 + l_linenumber AS row_id, l_returnflag = 'R' AS y, l_linestatus AS channel,
          l_returnflag AS truth, l_shipdate,
          CASE WHEN l_discount > 0.05 THEN 'R' WHEN l_tax > 0.04 THEN 'A' ELSE 'N' END AS predicted,
          l_partkey, l_suppkey,
          ((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey) % 700
            + CASE WHEN l_returnflag = 'R' THEN 200 ELSE 0 END) / 1000.0::DOUBLE AS score
        FROM lineitem""",
}


class Tables:
    """The given tables and the request-shaped views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def flows(self) -> DataFrame:
        e, user = self.events, F.col("user_id")
        hostile = user % 3 == 0
        fam, tool = _pick(FAMILIES, F.floor(user / 3) % 5), _pick(TOOLS, F.floor(user / 3) % 3)
        payload = _pick(WORDS, F.col("event_id") % 8)
        for family, texts in PAYLOADS.items():
            payload = F.when(hostile & (fam == family), _pick(texts, F.col("event_id") % 4)).otherwise(payload)
        text = lambda c: c.cast("string")
        subject = F.concat(F.lit('{"sub":"u'), text(user), F.lit('"}'))
        token = F.rtrim(F.translate(F.base64(F.encode(subject, "UTF-8")), "+/", "-_"), F.lit("="))
        k = F.get_json_object("props", "$.k").cast("bigint") % 5
        return e.select(
            F.col("event_id").alias("row_id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
            F.concat(F.lit("10.0."), text(F.floor(user / 256)), F.lit("."), text(user % 256)).alias("src_ip"),
            F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("http_method"),
            F.concat(F.lit("/"), "event_type", F.lit("/"), text(user % 40)).alias("url_path_raw"),
            F.concat(F.lit("k="), text(k), F.lit("&q="), payload).alias("url_query"),
            F.lit("").alias("request_body"),
            F.concat(F.lit('{"User-Agent":"agent/'), text(user % 7), F.lit('","'),
                     F.when(user % 2 == 0, "REFERER").otherwise("referrer"), F.lit('":"http://x/'), text(user % 5),
                     F.lit('","authorization":"Bearer h.'), token, F.lit('.s"}')).alias("headers"),
            F.when(F.col("event_type") != "error", F.lit(200).cast("bigint")).alias("response_status"),
            F.when(user % 2 == 0, "vampi").otherwise("zanbil").alias("app"),
            F.when(hostile, "attack").otherwise("benign").alias("label"),
            F.when(hostile, fam).alias("attack_family"), F.when(hostile, tool).alias("attack_tool"), "user_id")

    @cached_property
    def campaigns(self) -> DataFrame:
        f, user = self.flows, F.col("user_id")
        facts = ["app", "label", "attack_family", "attack_tool", "src_ip"]
        window = [F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts")]
        daily = f.where(user % 7 != 1).groupBy(
            F.concat(F.lit("c_"), "src_ip", F.lit("_"), F.substring("timestamp", 1, 10)).alias("campaign_id"),
            *facts).agg(*window)
        whole = f.where(user % 5 == 0).groupBy(
            F.concat(F.when(user % 10 == 0, "a_").otherwise("z_"), "src_ip").alias("campaign_id"),
            "app", F.lit("benign").alias("label"), F.lit(None).cast("string").alias("attack_family"),
            F.lit(None).cast("string").alias("attack_tool"), "src_ip").agg(*window)
        return daily.unionByName(whole).withColumn("ord", F.col("campaign_id"))

    @cached_property
    def requests(self) -> DataFrame:
        host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
        third = F.col("page_id") % 3
        return self.pages.select(
            F.col("page_id").alias("row_id"),
            F.when(F.col("page_id") % 4 == 0, "GET").otherwise("POST").alias("http_method"), host.alias("host"),
            F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("url_path_raw"),
            F.regexp_extract("url", "[?]([^#]*)", 1).alias("url_query"), F.col("html").alias("request_body"),
            F.concat(F.lit('{"Host":"'), host, F.lit('","USER-AGENT":"crawler/'), (F.col("page_id") % 9).cast("string"),
                     F.lit('","'), F.when(third == 0, "Referrer").when(third == 1, "referer").otherwise("x-from"),
                     F.lit('":"'), "url", F.lit('"}')).alias("headers"))

    @cached_property
    def posts(self) -> DataFrame:
        """Document texts as request bodies."""
        odd = F.substring("source", 4, 9).cast("bigint") % 2
        attack = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)) | (F.col("doc_id") % 5 == 0)
        return self.documents.join(self.labels, "doc_id", "left").select(
            F.col("doc_id").alias("row_id"), F.lit("POST").alias("http_method"),
            F.concat(F.lit("/"), "lang", F.lit("/"), "source").alias("url_path_raw"), F.lit("").alias("url_query"),
            F.col("text").alias("request_body"), F.lit("").alias("headers"), F.col("source").alias("source_id"),
            F.when(odd == 0, "real").otherwise("synthetic").alias("nature"),
            F.when(attack, "attack").otherwise("benign").alias("label"), F.col("lang").alias("attack_tool"))

    @cached_property
    def scores(self) -> DataFrame:
        c = F.col
        base = (c("l_orderkey") * 7919 + c("l_linenumber") * 104729 + c("l_partkey")) % 700
        return self.lineitem.select(
            (c("l_orderkey") * 8 + c("l_linenumber")).alias("row_id"), (c("l_returnflag") == "R").alias("y"),
            c("l_linestatus").alias("channel"), c("l_returnflag").alias("truth"), "l_shipdate",
            F.when(c("l_discount") > 0.05, "R").when(c("l_tax") > 0.04, "A").otherwise("N").alias("predicted"),
            "l_partkey", "l_suppkey",
            ((base + F.when(c("l_returnflag") == "R", 200).otherwise(0)) / F.lit(1000.0)).alias("score"))
