import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from wiretally.schema import UNIFIED_FIELDS
from wiretally.sources import lines, logs, sinks, tables


def write(path, text, opener=open):
    with opener(path, "wt", encoding="latin-1") as f:
        f.write(text)
    return str(path)


def test_line_numbers_run_through_blocks_and_files(spark, tmp_path):
    write(tmp_path / "a.log", "".join(f"a{i}\n" for i in range(3000)))
    write(tmp_path / "b.log", "b0\nb1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        rows = lines.read_lines(spark, str(tmp_path)).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in rows] == [f"a{i}" for i in range(3000)] + ["b0", "b1"]
    assert [r.row_id for r in rows] == list(range(3002)) and rows[-1].line_no == 2


def test_access_log(spark, tmp_path):
    good = '1.2.3.4 - - [22/Jan/2019:03:56:14 +0330] "GET /p%20q?x=1?y HTTP/1.1" 200 - "http://r" "ua \xe9" tail\n'
    path = write(tmp_path / "access.log", "broken\n" + good)
    row = logs.access_log(spark, path).drop("row_id").first().asDict()
    assert list(row) == UNIFIED_FIELDS
    assert (row["url_path"], row["url_path_raw"], row["url_query"], row["response_size"]) == ("/p q", "/p%20q", "x=1?y", 0)
    assert row["timestamp"] == "2019-01-22T03:56:14.000Z" and row["session_id"] == "zanbil:ip:1.2.3.4"
    import uuid
    from wiretally.functions.identity import ACCESS_LOG_NAMESPACE
    assert row["capture_id"] == str(uuid.uuid5(uuid.UUID(ACCESS_LOG_NAMESPACE), "zanbil:2"))
    stats = lines.ingest_stats(logs.parse_access_lines(lines.read_lines(spark, path))).first()
    assert (stats.source_lines, stats.parsed_rows, stats.parse_error_rate) == (2, 1, 0.5)


def test_access_log_ids_and_cut_bytes(spark, tmp_path):
    line = '1.2.3.4 - - [22/Jan/2019:03:56:14 +0330] "GET /p HTTP/1.1" 200 - "http://r" "{}"\n'
    for name in "abc":
        write(tmp_path / f"{name}.log", line.format("x") * 3 + line.format("\x01\x02a\x02b\x01") + "bad\x01" * 9 + "\n")
    rows = logs.access_log(spark, str(tmp_path)).collect()
    assert len(rows) == len({r.capture_id for r in rows}) == 12
    assert sorted({json.loads(r.headers)["User-Agent"] for r in rows}) == ["\x01\x02a\x02b\x01", "x"]


def test_archive_log_keeps_the_first_lines(spark, tmp_path):
    text = "".join(f'h - - [t] "GET {p} HTTP/1.0" 200 1\n' for p in ("/a", "b?q", "/a", "/c")) + '"bad"\n'
    path = write(tmp_path / "x.gz", text, gzip.open)
    rows = logs.archive_log(spark, path, "nasa", cap=3).orderBy("row_id").collect()
    assert [(r.url_path_raw, r.url_query) for r in rows] == [("/a", ""), ("/b", "q")]


def test_audit_log(spark, tmp_path):
    record = ("--aa-A--\nx\n--aa-B--\nPOST /u?v HTTP/1.1\nHost: h:1\nK: 1\nK: 2\nnocolon\n\nbody \xe9\n\nmore\n--aa-C--\nz\n--aa-Z--\n"
              "--bb-B--\nGET /only HTTP/1.1\nA:b\n--bb-Z--\n--cc-B--\nnot a request\n--cc-Z--\n")
    rows = {r.url_path_raw: r for r in logs.audit_log(spark, write(tmp_path / "d.log", record)).collect()}
    assert set(rows) == {"/u", "/only"}
    assert rows["/u"].request_body == "body \xe9\n\nmore" and json.loads(rows["/u"].headers) == {"Host": "h:1", "K": "2"}
    assert rows["/only"].request_body == "" and rows["/only"].source_id == "modsec"


def plain_sections(text):
    out, mode, held = [], None, []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        m = re.match(r"^--[0-9a-fA-F]+-([A-Z])--\s*$", line)
        if m:
            if mode == "B" and held:
                out.append("\n".join(held))
            mode, held = m[1], []
        elif mode == "B":
            held.append(line)
    return out


@pytest.mark.parametrize("split", ["300b", "64m"])
def test_audit_sections_run_over_splits(spark, tmp_path, split):
    """CRLF, records without a closing line, two B sections in a row, an unclosed last one, boundaries cut by splits."""
    draw = random.Random(len(split))
    expected = []
    for name in ("a", "b", "c"):
        text = ""
        for k in range(40):
            end = draw.choice(["\n", "\r\n"])
            text += f"--{k:02x}f-A--{end}stamp{end}--{k:02x}f-B--{end}GET /{name}{k} HTTP/1.1{end}H: {'x' * draw.choice([0, 3, 200])}{end}"
            text += draw.choice(["", f"{end}body {k}{end}", f"{end}a{end}{end}--not a boundary--{end}"])
            text += draw.choice([f"--{k:02x}f-Z--{end}", f"--{k:02x}f-F--{end}HTTP/1.1 403{end}", "", f"--{k:02x}f-B--  {end}"])
        expected += plain_sections(text)
        write(tmp_path / f"{name}.log", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = logs._numbered(logs.audit_sections(spark, str(tmp_path))).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in rows] == expected and [r.row_id for r in rows] == list(range(len(expected)))
    write(tmp_path / "d.txt", "no boundary\n" * 5)
    assert logs.audit_log(spark, str(tmp_path / "d.txt")).isEmpty()


def test_semi_synthetic_urls(spark, tmp_path):
    path = write(tmp_path / "c.csv", 'Method,User-Agent,URL,content,classification\n'
                 'GET,ua,http://h:80/a?b=1#f HTTP/1.1,,0\nPOST,ua,/x y HTTP/1.1,"k=1\nz",1\n')
    rows = {r.http_method: r for r in tables.semi_synthetic_csv(spark, path).collect()}
    assert (rows["GET"].url_path_raw, rows["GET"].url_query, rows["GET"].label) == ("/a", "b=1", "benign")
    assert (rows["POST"].url_path_raw, rows["POST"].request_body, rows["POST"].label) == ("/x", "k=1\nz", "attack")


def test_manifests_and_captures(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "b.json").write_text(json.dumps({"campaign_id": "x", "label": "benign", "app": "crapi",
                                                       "extra": {"feature_coverage": ["f"], "other": 1}}, indent=1))
    row = tables.manifests(spark, str(tmp_path / "m")).first()
    assert row.ord == "b.json" and row.extra.feature_coverage == ["f"]
    path = write(tmp_path / "c.jsonl", '{"timestamp":"2024-01-01T00:00:00.000Z","response_status":200}\n\n')
    assert tables.captures(spark, path).count() == 1


def test_sinks(spark, tmp_path):
    nested = {"a": {0.01: 0.5, "s": "text"}, "l": [1, None]}
    frame = sinks.metrics_frame(spark, nested)
    sinks.write_metrics(frame, str(tmp_path / "m"))
    assert {r.path: (r.value, r["str"]) for r in spark.read.schema(sinks.METRICS).json(str(tmp_path / "m")).collect()} == {
        "a/0.01": (0.5, None), "a/s": (None, "text"), "l/0": (1.0, None), "l/1": (None, None)}
    df = spark.createDataFrame([("t", "GET", 3)], "timestamp string, http_method string, src_port int")
    sinks.write_unified(df, str(tmp_path / "u"))
    sinks.write_unified(df, str(tmp_path / "u"), "append")
    assert tables.unified(spark, str(tmp_path / "u"), ["src_port"]).agg(F.sum("src_port")).first()[0] == 6


def test_label_rules(spark, tmp_path):
    path = write(tmp_path / "r.json", '{"rule_ord":2,"label":"b","filters":["y"]}\n{"rule_ord":1,"label":"a","filters":["x","z"]}\n')
    assert logs.read_label_rules(spark, path) == [("a", ["x", "z"]), ("b", ["y"])]
