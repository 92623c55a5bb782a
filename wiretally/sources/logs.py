"""Access logs and audit logs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wiretally.functions import clock, identity, rules, text as X
from wiretally.operators.dedup import first_per_key
from wiretally.operators.ranking import prefix, seeded_sample
from wiretally.schema import UNIFIED_SCHEMA, conform, tag_source
from wiretally.session import tabled
from wiretally.sources.lines import captured, from_latin1, read_lines, with_target

# Line shapes. A trailing or leading ".*" makes each one cover the whole line.
ACCESS_LINE = (r'(?s)^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([A-Z]+)\s+([^"\s]+)\s+HTTP/([0-9.]+)"\s+'
               r'(\d{3})\s+(\d+|-)\s+"([^"]*)"\s+"([^"]*)".*$')
HOST_LINE = (r'(?s)^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) (\S+) [^"]*" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)".*$')
ARCHIVE_LINE = r'(?s)^.*?"([A-Z]+)\s+(\S+)\s+HTTP/[0-9.]+".*$'
REQUEST_LINE = r"^([A-Z]+)\s+(\S+)\s+HTTP/[0-9.]+\s*$"
AUDIT_BOUNDARY = r"^--[0-9a-fA-F]+-([A-Z])--\s*$"
SHOP_SOURCE = "external=zanbil.ir nginx access log; organic benign, upper-bound FPR set"


def parse_access_lines(lines: DataFrame) -> DataFrame:
    """Combined access log: groups of each line plus ``parsed`` (see ``lines.ingest_stats``)."""
    return captured(lines, ACCESS_LINE, ["src_ip", "_ts", "http_method", "_target", "http_version", "_status", "_size",
                                         "_referer", "_ua"])


def access_log(spark: SparkSession, path: str, app: str = "zanbil", host: str = "zanbil.ir",
               label_source: str = SHOP_SOURCE, max_rows: int = 0) -> DataFrame:
    """Combined access log as unified rows (plus ``row_id``), all benign, no body."""
    parsed = parse_access_lines(read_lines(spark, path)).where("parsed")
    if max_rows:
        parsed = prefix(parsed, max_rows)
    rows = with_target(parsed, F.col("_target"))
    rows = rows.withColumns({
        # Counted over all files, so that ids don't repeat; of one file it is the line number.
        "capture_id": identity.uuid5(identity.ACCESS_LOG_NAMESPACE, F.concat(F.lit(f"{app}:"), (F.col("row_id") + 1).cast("string"))),
        "timestamp": clock.clf_local_iso(F.col("_ts")), "src_port": F.lit(0),
        "url_path": X.percent_decode(F.col("url_path_raw"), plus_is_space=False), "host": F.lit(host),
        "headers": F.to_json(F.create_map(F.lit("User-Agent"), "_ua", F.lit("Referer"), "_referer")),
        "request_body": F.lit(""), "request_content_type": F.lit(""), "response_status": clock.integer_or(F.col("_status")),
        "response_size": clock.integer_or(F.col("_size"), 0), "app": F.lit(app),
        "session_id": F.concat(F.lit(f"{app}:ip:"), "src_ip"), "label": F.lit("benign"),
        "campaign_id": F.lit(f"{app}_external"), "label_source": F.lit(label_source)})
    return conform(rows, UNIFIED_SCHEMA, "row_id")


def archive_log(spark: SparkSession, path: str, source_id: str, cap: int | None = None,
                partitions: int | None = None) -> DataFrame:
    """Common log lines, also gzipped (one task per file, so the rows are spread right after):
    unique benign requests, of the first ``cap`` parsed lines if a cap is given."""
    lines = read_lines(spark, path, latin1=True)
    if partitions:
        lines = lines.repartition(partitions)
    parsed = captured(lines, ARCHIVE_LINE, ["http_method", "_raw"]).where("parsed")
    if cap:
        parsed = prefix(parsed, cap)
    target = F.when(F.col("_raw").startswith("/"), F.col("_raw")).otherwise(F.concat(F.lit("/"), "_raw"))
    rows = with_target(parsed, target).select(
        "row_id", "http_method", "url_path_raw", "url_query", F.lit("").alias("request_body"), F.lit("").alias("headers"),
        F.lit("benign").alias("label"))
    return tag_source(first_per_key(rows, [X.signature_key()]), source_id, "real", False)


def parse_host_lines(lines: DataFrame, label_rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Multi-tenant combined log with the label of the first matching rule, before deduplication
    (group by ``gt_rule`` here for the raw volume)."""
    parsed = captured(lines, HOST_LINE, ["host", "_ts", "http_method", "_target", "_status", "_size", "_referer", "_ua"])
    rows = with_target(parsed.where("parsed"), F.col("_target")).withColumn(
        "gt_rule", rules.ordered_label(F.col("value"), label_rules))
    return rows.withColumns({
        "timestamp": clock.clf_local_iso(F.col("_ts")), "request_body": F.lit(""),
        "label": F.when(F.col("gt_rule") == "benign", "benign").otherwise("attack"),
        "headers": F.to_json(F.create_map(F.lit("User-Agent"), "_ua", F.lit("Referer"), "_referer"))})


def host_log(spark: SparkSession, path: str, label_rules: Sequence[tuple[str, Sequence[str]]], cap: int = 0) -> DataFrame:
    rows = parse_host_lines(read_lines(spark, path, latin1=True), label_rules)
    if cap:
        rows = prefix(rows, cap)
    unique = first_per_key(rows, [X.signature_key(["http_method", "url_path_raw", "url_query"])])
    return unique.select("row_id", "timestamp", "http_method", "url_path_raw", "url_query", "request_body", "headers",
                         "label", "gt_rule")


def read_label_rules(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Ordered rules from JSON lines (rule_ord, label, filters): a rule file, so a short list."""
    rows = spark.read.schema("rule_ord int, label string, filters array<string>").json(path).orderBy("rule_ord").collect()
    return [(r.label, list(r.filters)) for r in rows]


def audit_sections(spark: SparkSession, path: str | Sequence[str], section: str = "B") -> DataFrame:
    """(file, block, seq, value): the text of every section with a letter, in the order of the file, lines joined by line feeds.

    A section runs from its boundary line to the next one, of whatever letter; one that the file ends in is no section. Lines come from
    the splittable text reader (any line end), so a big day file is read by many tasks. Each split keeps what lies before its first
    boundary and behind its last one as fragments, and only these meet again, in file order; a section may run over any number of splits."""
    boundary = re.compile(AUDIT_BOUNDARY)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), from_latin1("value").alias("value"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, letter, seq, held = None, None, 0, []  # letter: None before the first boundary of a split

        def row(kind: str) -> tuple:
            return (*now, seq, kind, letter, "\n".join(held), len(held))

        for batch in rows:
            out = []
            for *of, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != now:
                    if now is not None:
                        out.append(row("end"))
                    now, letter, seq, held = of, None, 0, []
                if line.startswith("--") and (found := boundary.match(line)):
                    if letter is None:
                        out.append(row("begin"))
                    elif letter == section and held:
                        out.append(row("whole"))
                    seq, letter, held = seq + 1, found[1], []
                elif letter in (None, section):
                    held.append(line)
            yield _fragments(out)
        if now is not None:
            yield _fragments([row("end")])

    def join(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, None  # the open section: [block, seq, lines]
        for batch in rows:
            out = []
            for name, block, seq, kind, letter, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != file:
                    file, opened = name, None
                if letter is None and opened is not None and n:
                    opened[2].append(text)
                if kind == "begin":
                    if opened is not None and opened[2]:
                        out.append((file, opened[0], opened[1], "whole", section, "\n".join(opened[2]), 1))
                    opened = None
                elif letter is not None:
                    opened = [block, seq, [text] if n else []] if letter == section else None
            yield _fragments(out)

    found = tabled(lines.mapInArrow(cut, FRAGMENT), "sections")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    loose = found.where("kind <> 'whole'").repartition(n, "file").sortWithinPartitions("file", "block", "seq")
    return found.where("kind = 'whole'").unionByName(loose.mapInArrow(join, FRAGMENT)).select("file", "block", "seq", "value")


FRAGMENT = "file string, block long, seq long, kind string, letter string, value string, lines long"


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FRAGMENT.split(", ")])


def _numbered(sections: DataFrame) -> DataFrame:
    """``row_id``: the number of a section over all files in name order; counted per split, of what has been read already."""
    placed = sections.withColumn("_in", F.row_number().over(W.partitionBy("file", "block").orderBy("seq")) - 1)
    blocks = placed.groupBy("file", "block").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(W.orderBy("file", "block")) - F.col("_n")  # one row a split
    return placed.join(tabled(blocks.select("file", "block", ahead.alias("_ahead")), "blocks"), ["file", "block"]).withColumn(
        "row_id", F.col("_in") + F.col("_ahead")).drop("_in", "_ahead")


def audit_log(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """Multipart WAF audit log: request line, headers and body of every B section, all attacks; of equal requests the first."""
    section = _numbered(tabled(audit_sections(spark, path), "sections")).select("row_id", F.col("value").alias("_b"))
    halves = F.split("_b", r"\n[^\S\n]*\n", 2)
    parts = section.withColumns({"_head": F.get(halves, F.lit(0)), "_body": F.coalesce(F.get(halves, F.lit(1)), F.lit(""))})
    parts = parts.withColumn("_lines", F.split("_head", "\n")).withColumn("value", F.get("_lines", F.lit(0)))
    parts = captured(parts, REQUEST_LINE, ["http_method", "_target"]).where("parsed")
    pairs = F.transform(F.filter("_lines", lambda s, i: (i > 0) & s.contains(":")), lambda s: F.struct(
        X.strip(F.substring_index(s, ":", 1)).alias("key"),
        X.strip(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("value")))
    parts = parts.withColumn("_pairs", pairs)
    last = F.filter("_pairs", lambda e, i: ~F.exists(
        F.slice("_pairs", i + 2, F.greatest(F.size("_pairs"), F.lit(1))), lambda o: o["key"] == e["key"]))
    rows = with_target(parts, F.col("_target")).select(
        "row_id", "http_method", "url_path_raw", "url_query", X.strip(F.col("_body")).alias("request_body"),
        F.to_json(F.map_from_entries(last)).alias("headers"), F.lit("attack").alias("label"))
    unique = first_per_key(rows, [X.signature_key()])
    if sample:
        unique = seeded_sample(unique, sample, X.signature())
    return tag_source(unique, "modsec", "real", True)
