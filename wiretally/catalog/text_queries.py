"""Projections, scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.catalog.registry import query
from wiretally.functions import clock, hashing as H, identity, rules, shape, text as X
from wiretally.session import spread_out, tabled


# --- SQL fragments shared by the twins -------------------------------------------------------

def sql_decode(c: str, passes: int = 3) -> str:
    for _ in range(passes):
        c = f"url_decode(replace({c}, '+', ' '))"
    return c


def sql_text() -> str:
    return "url_path_raw || ' ' || url_query || ' ' || request_body"


def sql_rule(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}', 'is')"


def sql_any_rule(text: str) -> str:
    return "(" + " OR ".join(sql_rule(text, p) for p in rules.RULES.values()) + ")"


def sql_hits(text: str) -> str:
    cases = ", ".join(f"CASE WHEN {sql_rule(text, p)} THEN '{n}' END" for n, p in rules.RULES.items())
    return f"list_filter([{cases}], lambda h: h IS NOT NULL)"


def sql_bucket(key: str, m: int) -> str:
    digest = f"sha256('42:' || {key})"
    words = " + ".join(
        f"CAST('0x' || substr({digest}, {8 * w + 1}, 8) AS BIGINT) * {pow(2, 32 * (7 - w), m)}" for w in range(8))
    return f"(({words}) % {m})"


def sql_unit(key: str) -> str:
    return f"({sql_bucket(key, 10_000)} / 10000.0::DOUBLE)"


def sql_place(key: str) -> str:
    return f"CAST('0x' || substr(sha256('42:' || {key}), 1, 13) AS BIGINT)"


SQL_SIG = "http_method || '|' || url_path_raw || '|' || url_query || '|' || request_body"
SQL_UA = ("coalesce(json_extract_string(headers, '$.\"User-Agent\"'), "
          "json_extract_string(headers, '$.\"USER-AGENT\"'), '')")
SQL_REF = ("coalesce(json_extract_string(headers, '$.REFERER'), json_extract_string(headers, '$.referer'), "
           "json_extract_string(headers, '$.referrer'), json_extract_string(headers, '$.Referrer'), '')")


# --- decoding, headers, signatures -----------------------------------------------------------

@query("P1 P2 P3 P5", f"""
    SELECT row_id, decoded, path_once, CAST((a <> q) AS INT) + CAST((b <> a) AS INT) + CAST((c <> b) AS INT) AS depth
    FROM (SELECT *, {sql_decode('b', 1)} AS c FROM (SELECT *, {sql_decode('a', 1)} AS b FROM (
      SELECT row_id, url_query AS q, {sql_decode('url_query', 1)} AS a, {sql_decode('url_query')} AS decoded,
             url_decode(url_query) AS path_once FROM v_flows)))""")
def decode_flow_queries(t):
    """Decoded query text, passes used and the single pass that keeps ``+``."""
    return t.flows.select(
        "row_id", X.decode("url_query").alias("decoded"), X.decode_depth("url_query").alias("depth"),
        X.percent_decode(F.col("url_query"), plus_is_space=False).alias("path_once"))


@query("P1 P5", f"SELECT row_id, md5({sql_decode(sql_text())}) AS decoded_md5 FROM v_pages")
def decode_page_requests(t):
    """Whole page bodies decoded to a fixed point."""
    return t.requests.select("row_id", F.md5(X.decode(X.request_text())).alias("decoded_md5"))


@query("P3", """
    SELECT page_id AS row_id, split_part(url, '?', 1) AS path,
           CASE WHEN instr(url, '?') > 0 THEN substr(url, instr(url, '?') + 1) ELSE '' END AS query FROM pages""")
def split_targets(t):
    path, q = X.split_target(F.col("url"))
    return t.pages.select(F.col("page_id").alias("row_id"), path.alias("path"), q.alias("query"))


@query("P4 P5 P8", f"""
    SELECT row_id, {SQL_UA} AS user_agent, {SQL_REF} AS referer,
           {sql_decode(f"trim({SQL_UA} || ' ' || {SQL_REF})")} AS field_b
    FROM (SELECT row_id, headers FROM v_flows UNION ALL SELECT -1 - row_id, headers FROM v_pages)""")
def header_fields(t):
    """Case-insensitive header lookup with two spellings of one name."""
    both = t.flows.select("row_id", "headers").unionByName(
        t.requests.select((-1 - F.col("row_id")).alias("row_id"), "headers"))
    h = F.col("h")
    parsed = X.with_detector_fields(both.select(
        "*", X.header_entries("headers").alias("h"), *[F.lit("").alias(c) for c in ("url_path_raw", "url_query", "request_body")]))
    return parsed.select("row_id", X.lookup(h, "user-agent").alias("user_agent"),
                         X.lookup(h, "referer", "referrer").alias("referer"), "field_b")


@query("P6 P7", f"""
    SELECT row_id, md5({SQL_SIG}) AS full_md5, http_method || '|' || url_path_raw AS target_signature,
           coalesce(attack_tool, '') || '|' || url_path_raw AS variant FROM v_docs""")
def request_signatures(t):
    return t.posts.select(
        "row_id", F.md5(X.signature()).alias("full_md5"),
        X.signature(["http_method", "url_path_raw"]).alias("target_signature"),
        X.signature(["attack_tool", "url_path_raw"]).alias("variant"))


@query("P6", """
    SELECT row_id, '{"Host":"' || host || '","Path":"' || url_path_raw || '"}' AS fixed FROM v_pages""")
def header_objects(t):
    return t.requests.select("row_id", X.headers_json(Host=F.col("host"), Path=F.col("url_path_raw")).alias("fixed"))


@query("P13", f"""
    SELECT event_id AS row_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      substr('89ab', CAST(CAST('0x' || substr(h, 17, 1) AS BIGINT) % 4 AS INT) + 1, 1) || substr(h, 18, 3) || '-' ||
      substr(h, 21, 12) AS capture_id
    FROM (SELECT event_id, sha1(unhex('{identity.ACCESS_LOG_NAMESPACE.replace('-', '')}') ||
                               encode('zanbil:' || CAST(event_id AS VARCHAR))) AS h FROM events)""")
def capture_ids(t):
    name = F.concat(F.lit("zanbil:"), F.col("event_id").cast("string"))
    return t.events.select(F.col("event_id").alias("row_id"),
                           identity.uuid5(identity.ACCESS_LOG_NAMESPACE, name).alias("capture_id"))


@query("P14 P15", """
    SELECT row_id, 'u' || CAST(user_id AS VARCHAR) AS subject,
           CASE WHEN app = 'vampi' THEN 'vampi:user:u' || CAST(user_id AS VARCHAR) ELSE app || ':ip:' || src_ip END AS session_id
    FROM v_flows""")
def session_ids(t):
    subject = identity.token_subject(identity.token_payload(X.header("headers", "authorization")))
    return identity.with_session_id(t.flows).select("row_id", subject.alias("subject"), "session_id")


@query("P17 T10", """
    WITH s AS (SELECT CASE WHEN lower(regexp_extract(url_path_raw, '^/([^/?]*)', 1)) = '' THEN '(root)'
                           ELSE lower(regexp_extract(url_path_raw, '^/([^/?]*)', 1)) END AS site
               FROM (SELECT url_path_raw FROM v_flows UNION ALL SELECT url_path_raw FROM v_pages)),
         c AS (SELECT site, count(*) AS n FROM s GROUP BY 1)
    SELECT CASE WHEN n < 50 THEN '(small)' ELSE site END AS site, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def site_keys(t):
    """First path segment, rare ones folded into one bucket."""
    from wiretally.operators.ranking import collapse_small
    paths = t.flows.select("url_path_raw").unionByName(t.requests.select("url_path_raw"))
    return collapse_small(paths.withColumn("site", X.site_key()), "site", 50).groupBy("site").agg(
        F.count("*").alias("n"))


@query("P9 P10 P11 P32 F7", """
    SELECT event_id AS row_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS local_iso,
      CASE WHEN event_type = 'error' THEN '1970-01-01T00:00:00.000Z'
           ELSE strftime(ts - INTERVAL 210 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS utc_iso,
      CASE WHEN event_type = 'error' THEN FALSE ELSE TRUE END AS usable,
      strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS joined,
      epoch_us(date_trunc('millisecond', ts)) AS micros
    FROM events""")
def log_times(t):
    """Log times written out and parsed back: offset dropped, offset applied, bad text."""
    clf = F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0330"))
    broken = F.when(F.col("event_type") == "error", F.lit("yesterday")).otherwise(clf)
    utc = clock.clf_utc_iso(broken)
    iso = F.date_format("ts", clock.ISO_MILLIS)
    return t.events.select(
        F.col("event_id").alias("row_id"), clock.clf_local_iso(clf).alias("local_iso"), utc.alias("utc_iso"),
        clock.is_usable(clock.parse_iso(utc)).alias("usable"),
        clock.date_time_iso(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")).alias("joined"),
        F.unix_micros(clock.parse_iso(iso)).alias("micros"))


@query("P12", """
    SELECT event_id AS row_id, CASE WHEN event_type = 'view' THEN 0 ELSE event_id END AS size,
           CASE WHEN event_type = 'view' THEN NULL ELSE event_id END AS status FROM events""")
def safe_integers(t):
    raw = F.when(F.col("event_type") == "view", "-").otherwise(F.col("event_id").cast("string"))
    return t.events.select(F.col("event_id").alias("row_id"), clock.integer_or(raw, 0).alias("size"),
                           clock.integer_or(raw).alias("status"))


# --- shape features and n-grams --------------------------------------------------------------

@query("P20 P21 P22 P24 P25 P26", r"""
    WITH s AS (SELECT row_id, request_body AS s, length(request_body) AS n, url_path_raw AS p FROM v_pages)
    SELECT row_id, CAST(n AS DOUBLE) AS body_len,
      round(len(regexp_extract_all(s, '[^\p{L}\p{N}]')) / n, 6) AS nonalnum,
      round(len(regexp_extract_all(s, '\p{Nd}')) / n, 6) AS digits,
      round(len(regexp_extract_all(s, '\p{Lu}')) / n, 6) AS uppers,
      round(len(regexp_extract_all(s, '\s')) / n, 6) AS blanks,
      round(len(regexp_extract_all(s, '[''"<>;{}()|&`]')) / n, 6) AS punctuation,
      round(len(regexp_extract_all(s, '%[0-9A-Fa-f]{2}')) / n, 6) AS encoded,
      CAST(len(list_filter(string_split(p, '/'), lambda x: x <> '')) AS DOUBLE) AS path_depth,
      CAST(len(string_split(p, '/')) AS DOUBLE) AS segments FROM s""")
def character_classes(t):
    """Length and character-class shares of whole page bodies."""
    s, r6 = F.col("request_body"), lambda c: F.round(c, 6)
    b = shape.block("b", s)
    return t.requests.select(
        "row_id", b["b_len"].alias("body_len"), r6(b["b_nonalnum_ratio"]).alias("nonalnum"),
        r6(b["b_digit_ratio"]).alias("digits"), r6(b["b_upper_ratio"]).alias("uppers"),
        r6(b["b_space_ratio"]).alias("blanks"), r6(b["b_punct_density"]).alias("punctuation"),
        r6(shape.percent_encoded_ratio(s)).alias("encoded"),
        F.size(F.filter(F.split("url_path_raw", "/"), lambda x: x != "")).cast("double").alias("path_depth"),
        F.size(F.split("url_path_raw", "/", -1)).cast("double").alias("segments"))


@query("P23", """
    SELECT row_id, round(list_entropy(string_split(request_body, '')), 6) AS entropy FROM v_docs""")
def body_entropy(t):
    return t.posts.select("row_id", F.round(shape.entropy(F.col("request_body")), 6).alias("entropy"))


SQL_BLANK = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"


def sql_shape() -> str:
    def stripped(s: str) -> str:
        return f"regexp_replace({s}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"

    def share(s: str, pattern: str) -> str:
        return f"CASE WHEN length({s}) > 0 THEN round(len(regexp_extract_all({s}, '{pattern}')) / length({s}), 6) ELSE 0.0::DOUBLE END"

    patterns = {"nonalnum_ratio": r"[^\p{L}\p{N}]", "digit_ratio": r"\p{Nd}", "upper_ratio": r"\p{Lu}", "space_ratio": SQL_BLANK,
                "punct_density": "[''\"<>;{}()|&`]"}
    columns = []
    for name, s in zip(shape.BLOCKS, "pqbh"):
        columns += [f"CAST(length({s}) AS DOUBLE) AS {name}_len", f"round(list_entropy(string_split({s}, '')), 6) AS {name}_entropy",
                    *[f"{share(s, pattern)} AS {name}_{stat}" for stat, pattern in patterns.items()]]
    sources = " UNION ALL ".join(f"SELECT {key} AS row_id, url_path_raw, url_query, request_body, headers FROM {view}"
                                 for key, view in (("row_id", "v_flows"), ("-1 - row_id", "v_pages")))
    passes = ", ".join(f"{sql_decode('a0', n)} AS a{n}, {sql_decode('h0', n)} AS h{n}" for n in (1, 2, 3))
    changed = lambda x: " + ".join(f"CAST({x}{n + 1} <> {x}{n} AS INT)" for n in range(3))
    return f"""
    WITH r AS ({sources}),
      t AS (SELECT *, {stripped(sql_text())} AS a0, {stripped(f"{SQL_UA} || ' ' || {SQL_REF}")} AS h0 FROM r),
      d AS (SELECT *, {passes}, {sql_decode('url_path_raw')} AS p, {sql_decode('url_query')} AS q, {sql_decode('request_body')} AS b FROM t),
      x AS (SELECT *, h3 AS h FROM d)
    SELECT row_id, CAST(length(a3) AS DOUBLE) AS total_len, CAST(length(q) - length(replace(q, '=', '')) AS DOUBLE) AS query_param_count,
      CAST(len(list_filter(string_split(p, '/'), lambda x: x <> '')) AS DOUBLE) AS path_depth, CAST(len(string_split(p, '/')) AS DOUBLE) AS segment_count,
      CAST(greatest({changed('a')}, {changed('h')}) AS DOUBLE) AS encoding_depth, {share('a0', '%[0-9A-Fa-f]{2}')} AS pct_encoded_ratio,
      {', '.join(columns)} FROM x"""


@query("P20 P21 P22 P26", sql_shape())
def shape_features(t):
    """All 34 columns of the numeric feature block, of every flow and of every page with its whole body."""
    fields = ["row_id", "url_path_raw", "url_query", "request_body", "headers"]
    both = t.flows.select(fields).unionByName(t.requests.withColumn("row_id", -1 - F.col("row_id")).select(fields))
    return shape.with_shape_features(both).select("row_id", *[F.round(c, 6).alias(c) for c in shape.FEATURE_NAMES])


#: Decoded target and whole body of every page, and the n-grams of it.
SQL_GRAMS = f"""u AS (SELECT row_id, regexp_replace({sql_decode(sql_text())}, '{SQL_BLANK}{{2,}}', ' ', 'g') AS s FROM v_pages),
         g AS (SELECT row_id, unnest(flatten(list_transform([3, 4, 5], lambda n:
                 list_transform(range(1, length(s) - n + 2), lambda i: substr(s, i, n))))) AS term FROM u)"""


def page_texts(t):
    """Decoded requests, dealt out over all cores before they are decoded. A pass leaves a text without escapes as it is."""
    out = spread_out(t.requests.select("row_id", X.request_text().alias("_s0")))
    for n in range(X.DECODE_PASSES):
        s = F.col(f"_s{n}")
        out = out.withColumn(f"_s{n + 1}", F.when(s.contains("%") | s.contains("+"), X.percent_decode(s)).otherwise(s))
    return out.select("row_id", F.col(f"_s{X.DECODE_PASSES}").alias("s"))


@query("P27 A28", f"""
    WITH {SQL_GRAMS}
    SELECT term, count(DISTINCT row_id) AS documents, count(*) AS occurrences
    FROM g GROUP BY term HAVING count(DISTINCT row_id) >= 2""")
def ngram_terms(t):
    """Document and collection frequency of the n-grams of every page: address and whole body."""
    from wiretally.plans.vectors import term_statistics
    return term_statistics(page_texts(t), "s", min_df=2)


@query("M1", f"""
    WITH {SQL_GRAMS},
         tf AS (SELECT row_id, term, count(*) AS tf FROM g GROUP BY ALL),
         df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM u)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term HAVING count(*) >= 2),
         w AS (SELECT row_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN df USING (term)),
         l AS (SELECT row_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY row_id)
    SELECT row_id, count(*) AS terms, round(max(w / norm), 6) AS heaviest, round(sum(w / norm), 5) AS total
    FROM w JOIN l USING (row_id) GROUP BY row_id""")
def tfidf_weights(t):
    """Sublinear TF-IDF with smoothed IDF and unit rows, summarised per request."""
    from wiretally.plans.vectors import TfIdf
    texts = tabled(page_texts(t), "texts")
    model = TfIdf("s", "v").fit(texts)
    w = model.weights(model.transform(texts), "v")
    return w.where(F.size("weights") > 0).select(
        "row_id", F.size("terms").cast("bigint").alias("terms"), F.round(F.array_max("weights"), 6).alias("heaviest"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("P28", """
    SELECT row_id, round(ln(p / (1 - p)), 6) AS z, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS back
    FROM (SELECT row_id, greatest(least(score, 1 - 1e-6), 1e-6) AS p FROM v_scores)""")
def logit_scores(t):
    z = shape.logit(F.col("score"))
    return t.scores.select("row_id", F.round(z, 6).alias("z"), F.round(shape.sigmoid(z), 6).alias("back"))


@query("P29 P30", f"""
    SELECT row_id, {sql_decode("url_path_raw || ' ' || url_query")} || ' ' || {sql_decode('request_body')} AS family_text,
           substr(headers, 1, 40) AS shown FROM v_flows""")
def family_texts(t):
    return t.flows.select("row_id", X.family_text().alias("family_text"), X.review_text("headers", 40).alias("shown"))


# --- predicates ------------------------------------------------------------------------------

@query("F2 F3", f"""
    WITH d AS (SELECT row_id, {sql_decode(sql_text())} AS s FROM v_flows)
    SELECT row_id, {sql_any_rule('s')} AS flagged,
           CASE WHEN len({sql_hits('s')}) > 0 THEN array_to_string({sql_hits('s')}, ',') END AS hits FROM d""")
def rule_flags(t):
    """Rule baseline on the decoded request: the flag and which rules fire."""
    d = t.flows.select("row_id", X.decode(X.request_text()).alias("s"))
    return d.select("row_id", rules.any_rule(F.col("s")).alias("flagged"),
                    F.array_join(rules.rule_hits(F.col("s")), ",").alias("hits"))


@query("F2 F3", f"""
    WITH d AS (SELECT row_id, {sql_decode(sql_text())} AS s FROM v_pages)
    SELECT array_to_string({sql_hits('s')}, ',') AS hits, count(*) AS n FROM d GROUP BY 1""")
def page_rule_hits(t):
    """Rules that fire on whole page bodies, as counts per combination."""
    d = t.requests.select(X.decode(X.request_text()).alias("s"))
    hits = F.coalesce(F.array_join(rules.rule_hits(F.col("s")), ","), F.lit(""))
    return d.groupBy(hits.alias("hits")).agg(F.count("*").alias("n"))


@query("F4 F5 F6", f"""
    SELECT row_id, {sql_rule(sql_text(), rules.INJECTION_MARKERS)} AS injection,
           {sql_rule(sql_text(), rules.ALERT_MARKERS)} AS alert,
           {sql_rule(sql_decode(sql_text()), rules.DECODED_MARKERS)} AS decoded FROM v_flows""")
def audit_markers(t):
    """The three audit dialects: raw injection, raw alert, decoded."""
    text = X.request_text()
    return t.flows.select("row_id", rules.matches(text, rules.INJECTION_MARKERS).alias("injection"),
                          rules.matches(text, rules.ALERT_MARKERS).alias("alert"),
                          rules.matches(X.decode(text), rules.DECODED_MARKERS).alias("decoded"))


@query("F1", """
    SELECT attack_family, attack_tool, count(*) AS n FROM v_flows
    WHERE label = 'attack' AND attack_family IN ('sqli', 'xss') AND attack_tool <> 'custom' GROUP BY 1, 2""")
def label_filters(t):
    c = F.col
    return t.flows.where((c("label") == "attack") & c("attack_family").isin("sqli", "xss") & (c("attack_tool") != "custom")
                         ).groupBy("attack_family", "attack_tool").agg(F.count("*").alias("n"))


LABEL_RULES = [("probe", ["%etc%", "passwd"]), ("markup", ["%3cscript"]), ("login", ["signup", "k=1"])]


@query("J9 K8 F10", """
    WITH l AS (SELECT row_id, lower(http_method || ' ' || url_path_raw || '?' || url_query) AS line,
                      http_method || '|' || url_path_raw || '|' || url_query AS sig FROM v_flows),
         r AS (SELECT *, CASE WHEN contains(line, 'etc') AND contains(line, 'passwd') THEN 'probe'
                              WHEN contains(line, '3cscript') THEN 'markup'
                              WHEN contains(line, 'signup') AND contains(line, 'k=1') THEN 'login' ELSE 'benign' END AS gt_rule FROM l),
         f AS (SELECT sig, arg_min(gt_rule, row_id) AS gt_rule FROM r GROUP BY sig)
    SELECT gt_rule, n, n_unique FROM (SELECT gt_rule, count(*) AS n FROM r GROUP BY 1)
    LEFT JOIN (SELECT gt_rule, count(*) AS n_unique FROM f GROUP BY 1) USING (gt_rule)""")
def ordered_rule_volume(t):
    """Ordered substring rules on the raw line; label volume before and after deduplication."""
    from wiretally.operators.dedup import first_per_key
    line = F.concat("http_method", F.lit(" "), "url_path_raw", F.lit("?"), "url_query")
    rows = t.flows.select("row_id", X.signature(["http_method", "url_path_raw", "url_query"]).alias("sig"),
                          rules.ordered_label(line, LABEL_RULES).alias("gt_rule"))
    raw = rows.groupBy("gt_rule").agg(F.count("*").alias("n"))
    unique = first_per_key(rows, ["sig"]).groupBy("gt_rule").agg(F.count("*").alias("n_unique"))
    return raw.join(unique, "gt_rule", "left")


@query("X1", f"""
    SELECT row_id, {sql_bucket('CAST(row_id AS VARCHAR)', 10)} AS b10, {sql_bucket('CAST(row_id AS VARCHAR)', 100)} AS b100,
           {sql_unit('CAST(row_id AS VARCHAR)')} AS unit FROM v_flows""")
def hash_buckets(t):
    key = F.col("row_id").cast("string")
    return t.flows.select("row_id", H.bucket(key, 10).alias("b10"), H.bucket(key, 100).alias("b100"), H.unit(key).alias("unit"))
