"""URL filter: longest host and path rule, else a list of canonical URLs; both looked up through a blocked Bloom filter.

DataFrame functions only. Each distinct (host, path) gives a few keys: every parent domain with every path prefix that is as
long as some rule's path, and its canonical form. A key touches one block of 8 x 32 bits; keys whose bits are all set go on
to an exact hash join, which removes the false positives. Neither the filter nor the list is ever hinted to be broadcast:
Spark does so where their measured size allows and shuffles them otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: Filter bits per listed key; with 8 bits set per key about one key in 2 000 passes by chance.
BITS_PER_KEY = 16


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., path without a closing slash or .html; scheme, query and fragment are gone."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def _placed(key: Column, blocks: int) -> list[Column]:
    """The block of a key and, for each word of it, the one bit that is set."""
    second = F.xxhash64(key, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(second, 5 * i).bitwiseAND(F.lit(31)).cast("int")).alias(f"b{i}") for i in range(WORDS)]
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *bits]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): one row per block that has a key. Bits are combined before the shuffle."""
    return listed.select(*_placed(F.col("key"), blocks)).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def possible(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of ``keys`` (column key) that the Bloom filter of ``listed`` (column key) lets through."""
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // (32 * WORDS)))
    hit = " and ".join(f"(b{i} & w{i}) <> 0" for i in range(WORDS))
    return keys.select("*", *_placed(F.col("key"), blocks)).join(bloom_filter(listed, blocks), "block").where(hit).select(*keys.columns)


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, listed_verdict: str = "block", other: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``rules`` (host, path, verdict): fits its host and all subdomains where the path starts with the rule's; the longest
    host and path together wins, then the longer host, then the lesser verdict. ``listed`` (host, path): URLs judged by
    ``listed_verdict`` where no rule fits, compared in canonical form; all else is ``other``. A null url or one without
    ``://`` has an empty host and path and fits no rule. Repeated rows are judged each; an empty table gives no rows."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule_keys = rules.select(F.concat("host", "path").alias("rule"), F.struct(
        (F.length("host") + F.length("path")).alias("long"), F.length("host").alias("host_long"), F.concat("host", "path").alias("rule"),
        "verdict").alias("said"), F.concat_ws("\n", "host", "path").alias("key")).groupBy("key").agg(F.min("said").alias("said"))
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())  # bounded by the longest path
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array()
    pairs = urls.select("host", "path").distinct()
    looked_up = pairs.select("host", "path", F.explode(parents).alias("parent")).select(
        "host", "path", "parent", F.explode(F.array_compact(prefixes)).alias("prefix")) if lengths else None
    found = None
    if looked_up is not None:
        keys = looked_up.select("host", "path", F.concat_ws("\n", "parent", "prefix").alias("key"))
        found = possible(keys, rule_keys.select("key")).join(rule_keys, "key").groupBy("host", "path").agg(
            F.max(F.struct("said.long", "said.host_long", "said.rule")).alias("top"), F.max_by("said.verdict", F.struct("said.long", "said.host_long", "said.rule")).alias("rule_verdict"))
    listed_keys = listed.select(canonical(F.col("host"), F.col("path")).alias("key")).distinct()
    own = pairs.select("host", "path", canonical(F.col("host"), F.col("path")).alias("key"))
    on_list = possible(own, listed_keys).join(listed_keys, "key", "left_semi").select("host", "path", F.lit(listed_verdict).alias("list_verdict"))
    judged = pairs.join(on_list, ["host", "path"], "left")
    judged = judged.join(found, ["host", "path"], "left") if found is not None else judged.withColumns(
        {"top": F.lit(None).cast("struct<rule:string>"), "rule_verdict": F.lit(None).cast("string")})
    return urls.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("rule_verdict", "list_verdict", F.lit(other)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
