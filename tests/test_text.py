import base64
import json
import random
import re
import uuid
from collections import Counter
from math import log2
from urllib.parse import quote, unquote_plus

import pytest
from pyspark.sql import functions as F

from wiretally.functions import clock, hashing, identity, rules, shape, text as X
from wiretally.operators import mutations

PROBES = ["/a%2Fb+c", "%2527%2520", "100%", "%zz%41", "%4", "%c0%af", "%E2%82", "a%FFb%41", "", None, "plain", "%25252527"]


def column(spark, values, expr, name="s"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.select(F.col("i"), expr.alias("x")).orderBy("i").select("x").collect()]


def fixed_point(s):
    cur, depth = s or "", 0
    for _ in range(3):
        nxt = unquote_plus(cur)
        if nxt == cur:
            break
        cur, depth = nxt, depth + 1
    return cur, depth


def random_texts(n, alphabet="ab%25 +/é42zF'=", seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_decode_matches_python(spark):
    values = PROBES + random_texts(800)
    expected = [fixed_point(v) for v in values]
    assert column(spark, values, X.decode("s")) == [e[0] for e in expected]
    assert column(spark, values, X.decode_depth("s")) == [e[1] for e in expected]


def test_split_target(spark):
    values = ["/p?a=1?b", "/p?", "/p", ""]
    path, query = X.split_target(F.col("s"))
    assert column(spark, values, path) == ["/p", "/p", "/p", ""]
    assert column(spark, values, query) == ["a=1?b", "", "", ""]


@pytest.mark.parametrize("headers, names, expected", [
    ('{"REFERER":"a"}', ("referer", "referrer"), "a"), ('{"Referrer":"b","Referer":""}', ("referer", "referrer"), "b"),
    ('{"User-Agent":7}', ("user-agent",), "7"), ("{broken", ("user-agent",), ""), ("", ("x",), ""), (None, ("x",), ""),
    ('{"x":"1","X":"2"}', ("x",), "2"), ('{"other":"1"}', ("x", "y"), "")])
def test_header(spark, headers, names, expected):
    assert column(spark, [headers], X.header("s", *names)) == [expected]


def token(payload, scheme="Bearer"):
    body = base64.urlsafe_b64encode(json.dumps(payload).encode()).decode().rstrip("=")
    return f"{scheme} h.{body}.s"


def test_token_subject(spark):
    values = [token({"sub": "ann"}), token({"sub": {"username": "bo"}}), token({"sub": {"user": "cy"}}), token({"x": 1}),
              token({"sub": 5}), "Bearer a.b", "Bearer a.!!.c", "Basic x.y.z", "", token({"sub": "ü"}, "bearer")]
    assert column(spark, values, identity.token_subject(identity.token_payload(F.col("s")))) == [
        "ann", "bo", "cy", None, "5", None, None, None, None, "ü"]


def test_uuid5(spark):
    values = [f"zanbil:{i}" for i in range(60)]
    space = uuid.UUID(identity.ACCESS_LOG_NAMESPACE)
    assert column(spark, values, identity.uuid5(identity.ACCESS_LOG_NAMESPACE, F.col("s"))) == [
        str(uuid.uuid5(space, v)) for v in values]


def test_ngrams(spark):
    values = ["", "ab", "abc", "abcde", "a  \t b", "añ🙂cd"]

    def expected(s):
        s = re.sub(r"\s\s+", " ", s)
        return [s[i:i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1)]

    assert column(spark, values, X.ngrams("s")) == [expected(v) for v in values]


def test_shape(spark):
    values = ["", "1234", "Aé ß\t<x>;|", "hello world " * 3000, "ÅB c"]

    def entropy(s):
        return -sum(k / len(s) * log2(k / len(s)) for k in Counter(s).values()) if s else 0.0

    block = shape.block("b", F.col("s"))
    assert column(spark, values, block["b_entropy"]) == pytest.approx([entropy(v) for v in values])
    for stat, test in (("nonalnum_ratio", lambda c: not c.isalnum()), ("digit_ratio", str.isdigit),
                       ("upper_ratio", str.isupper), ("space_ratio", str.isspace), ("punct_density", shape.PUNCTUATION.__contains__)):
        assert column(spark, values, block[f"b_{stat}"]) == pytest.approx(
            [sum(map(test, v)) / len(v) if v else 0.0 for v in values]), stat
    assert len(shape.FEATURE_NAMES) == len(set(shape.FEATURE_NAMES)) == 34


def test_clock(spark):
    values = ["22/Jan/2019:03:56:14 +0330", "nonsense", ""]
    assert column(spark, values, clock.clf_local_iso(F.col("s"))) == ["2019-01-22T03:56:14.000Z", "", ""]
    assert column(spark, values, clock.clf_utc_iso(F.col("s"))) == [
        "2019-01-22T00:26:14.000Z", "1970-01-01T00:00:00.000Z", "1970-01-01T00:00:00.000Z"]
    iso = ["2024-01-01T00:00:01.500Z", "2024-01-01", None]
    assert column(spark, iso, F.unix_millis(clock.parse_iso("s"))) == [1704067201500, None, None]
    assert column(spark, ["12", "-", "x1", ""], clock.integer_or(F.col("s"), 0)) == [12, 0, 0, 0]


def test_hash_is_the_big_integer(spark):
    import hashlib
    values = [f"k{i}" for i in range(300)]
    for m in (10, 100, 10_000):
        expected = [int(hashlib.sha256(f"42:{v}".encode()).hexdigest(), 16) % m for v in values]
        assert column(spark, values, hashing.bucket(F.col("s"), m)) == expected


@pytest.mark.parametrize("name, hit, miss", [
    ("sqli", "1 UNION\n SELECT x", "unionselect"), ("xss", "<IMG a src", "<image>"), ("path_traversal", "..\\x", "a..b"),
    ("cmd_injection", "; ID", "idle; idea "), ("ssti", "{{7*7}}", "{7}"), ("ssrf", "http://LOCALHOST", "local host"),
    ("nosql_injection", "a[$ne]", "$nested"), ("scan", "/.git/config", "/git")])
def test_rules(spark, name, hit, miss):
    values = [hit, miss if name != "cmd_injection" else "idle, idea"]
    got = column(spark, values, rules.matches(F.col("s"), rules.RULES[name]))
    assert got == [bool(re.search(rules.RULES[name], v, re.I)) for v in values] and got[0] and not got[1]


def test_ordered_label(spark):
    table = [("both", ["%foo", "Bar%"]), ("one", ["foo"]), ("never", ["%"])]
    assert column(spark, ["x FOO bar", "foo", "bar"], rules.ordered_label(F.col("s"), table)) == ["both", "one", "benign"]


def test_rewrites_match_plain_python(spark):
    values = ["1' or 'abc'='abc' union select name", "abcd efgh ijkl mnop", "a*b~c+d é<x>", "no quotes", "''", "'" + "q" * 21 + "'"]
    seed = F.lit("")

    def comment(s):
        return re.sub(r"([A-Za-z]{2})([A-Za-z]{2,})", r"\1/**/\2", s.replace(" ", "/**/"), count=3)

    def codes(s):
        return re.sub("'([^']{1,20})'", lambda m: "CHAR(" + ",".join(str(ord(c)) for c in m[1]) + ")", s)

    assert column(spark, values, mutations.inline_comment(F.col("s"), seed)) == [comment(v) for v in values]
    assert column(spark, values, mutations.keyword_char(F.col("s"))) == [codes(v) for v in values]
    assert column(spark, values, mutations.double_url_encode(F.col("s"))) == [quote(quote(v, safe=""), safe="") for v in values]
    lowered = column(spark, values, F.lower(mutations.random_case(F.col("s"), seed)))
    assert lowered == [v.lower() for v in values]


def test_vocabulary_is_the_same_for_rows_in_any_order(spark):
    from wiretally.plans.vectors import TfIdf, term_statistics
    texts = ["abcabc", "bcab", "", None, "abc  \tx", "zzz", "\U0001F600bca\U0001F600bca", "abcabc"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    grams = [x for x in rows.select(X.ngrams("s").alias("g")).toPandas()["g"]]
    expected = {}
    for row in grams:
        for term in set(row):
            documents, occurrences = expected.get(term, (0, 0))
            expected[term] = (documents + 1, occurrences + list(row).count(term))
    got = {r.term: (r.documents, r.occurrences) for r in term_statistics(rows, "s").collect()}
    assert got == {t: c for t, c in expected.items() if c[0] >= 2}
    models = [TfIdf("s", "v", max_terms=5).fit(d) for d in (rows, rows.orderBy(F.desc("k")).repartition(3))]
    best = sorted(got, key=lambda t: (-got[t][1], t))[:5]
    assert [set(m.counts.vocabulary) for m in models] == [set(best), set(best)]
    assert TfIdf("s", "v").fit(rows.where("k = 5")) is None


def _plain_grams(texts):
    """What the n-grams of texts are by the column expression's rule, in plain Python."""
    cleaned = [re.sub(r"[\s\x1c-\x1f]{2,}", " ", t or "") for t in texts]
    return [Counter(t[i:i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)) for t in cleaned]


ODD_TEXTS = ["abcabc", "bcab", "", None, "ab", "abc  \tx", "\x00\x00a\x00\x00a", "\U0001F600bca\U0001F600bca", "￿\U0010ffff￿\U0010ffff", "abcabc", "é" * 40]


@pytest.mark.parametrize("characters", [1 << 20, 12, 1])
@pytest.mark.parametrize("wide", [False, True])
def test_counted_grams_match_plain_python(monkeypatch, characters, wide):
    """In pieces of any length, and with so many different characters that five of them do not fit one number."""
    import pyarrow as pa
    from wiretally.plans import vectors
    monkeypatch.setattr(vectors, "CHARACTERS", characters)
    texts = [None if t is None else re.sub(r"[\s\x1c-\x1f]{2,}", " ", t) for t in ODD_TEXTS]
    if wide:
        texts += ["".join(map(chr, range(0x4e00, 0x4e00 + 9000))) + "abcabc", "".join(map(chr, range(0x10000, 0x10000 + 9000)))]
    found = {}
    for piece in vectors._pieces(pa.array(texts)):
        for batch in vectors._counted(piece):
            for term, documents, occurrences in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = found.get(term, (0, 0))
                found[term] = (a + documents, b + occurrences)
    grams, totals, rows = _plain_grams(texts), Counter(), Counter()
    for g in grams:
        totals.update(g)
        rows.update(g.keys())
    assert found == {t: (rows[t], totals[t]) for t in totals}


def test_vectors_match_plain_python(spark, tmp_path):
    """Weights of known terms, rows without any, and a model that is stored and loaded."""
    import math
    from wiretally.plans.vectors import TfIdf, TfIdfModel
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD_TEXTS)], "k int, s string").repartition(3)
    model = TfIdf("s", "v").fit(rows)
    model.save(f"{tmp_path}/space")
    again = TfIdfModel.load(f"{tmp_path}/space")
    assert again.counts.vocabulary == model.counts.vocabulary and list(again.counts.idf) == list(model.counts.idf)
    grams = _plain_grams(ODD_TEXTS)
    df = Counter(t for g in grams for t in g)
    assert set(model.counts.vocabulary) == {t for t, n in df.items() if n >= 2}
    for r in TfIdfModel.weights(again.transform(rows), "v").collect():
        expected = {t: (1 + math.log(n)) * (math.log((1 + len(ODD_TEXTS)) / (1 + df[t])) + 1) for t, n in grams[r.k].items() if df[t] >= 2}
        norm = math.sqrt(sum(w * w for w in expected.values()))
        assert {model.counts.vocabulary[i]: pytest.approx(w) for i, w in zip(r.terms, r.weights, strict=True)} == {t: w / norm for t, w in expected.items()}
        assert r.v.size == model.size and list(r.terms) == sorted(r.terms)


def test_pages_are_dealt_out_before_they_are_decoded(small):
    from wiretally.catalog.text_queries import page_texts
    assert page_texts(small).rdd.getNumPartitions() >= small.spark.sparkContext.defaultParallelism
