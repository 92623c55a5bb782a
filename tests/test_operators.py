import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretally.functions import text as X
from wiretally.operators import dedup, labelling, membership, metrics, neighbours, quality, quantiles, ranking, splits


def scores(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)


@pytest.mark.parametrize("n", [0, 1, 2, 99, 100, 101, 1000])
@pytest.mark.parametrize("direct", [50_000, 3])
def test_order_values_match_numpy(spark, monkeypatch, n, direct):
    """With a small direct limit the cells are narrowed round by round."""
    if direct == 3 and n not in (101, 1000):
        pytest.skip("narrowing needs rows")
    monkeypatch.setattr(quantiles, "DIRECT", direct)
    monkeypatch.setattr(quantiles, "CELLS", 16 if direct == 3 else 4096)
    values = np.random.default_rng(n).beta(0.3, 4, n).round(4)
    df = scores(spark, values)
    got = quantiles.budget_thresholds(df, "v")
    for a in (0.01, 0.05):
        assert got[a] == (np.quantile(values, 1 - a, method="higher") if n else 0.5)
    linear = quantiles.quantile_linear(df, "v", 0.7)
    assert linear == (pytest.approx(np.quantile(values, 0.7)) if n else None)


def test_all_ties_and_one_outlier(spark):
    df = scores(spark, [0.25] * 500 + [1e9])
    assert quantiles.quantile_higher(df, "v", 0.5) == 0.25
    assert quantiles.quantile_higher(df, "v", 1.0) == 1e9


def test_group_statistics_with_one_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.lognormal(0, 3, 3000)] + [(f"g{i}", float(x)) for i in range(5) for x in rng.random(i + 1)]
    got = {r.g: r for r in quantiles.group_quantile_linear(
        spark.createDataFrame(rows, "g string, v double"), "v", 0.7, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        v = [x for k, x in rows if k == g]
        assert got[g].n == len(v) and got[g]["quantile"] == pytest.approx(np.quantile(v, 0.7))


def test_group_with_outliers_on_two_scales(spark, monkeypatch):
    draw = np.random.default_rng(14)
    values = np.concatenate([draw.normal(size=100_000), [1e8] * 3, draw.normal(size=50) * 1e8, [1e300, -1e300], np.zeros(5000)])
    small = draw.integers(0, 9, 700).astype(float)
    df = spark.createDataFrame([("big", float(x)) for x in values] + [("small", float(x)) for x in small] + [("one", 2.5), ("none", None)], "g string, v double")
    left, bracketed = [], quantiles._bracketed

    def seen(*args):
        out = bracketed(*args)
        left.append(out[0].groupBy("_pick").agg(F.count_distinct("_v").alias("n")).agg(F.max("n")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "_bracketed", seen)
    monkeypatch.setattr(quantiles, "LAST", 900)
    ranks = {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "p99": lambda n: F.floor(n * 0.99), "top": lambda n: n}
    got = {r.g: r for r in quantiles.order_statistics(df, "v", ranks, ["g"]).collect()}
    assert set(got) == {"big", "small", "one"}
    for g, x in (("big", values), ("small", small), ("one", np.array([2.5]))):
        x = np.sort(x)
        assert [got[g][k] for k in ranks] == [x[0], x[len(x) // 2], x[int(np.floor(len(x) * 0.99))], x[-1]] and got[g].n == len(x)
    assert left and left[-1] < len(values) / 100


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), float("-inf")])
def test_values_without_a_place_are_refused(spark, odd):
    df = spark.createDataFrame([("a", 1.0), ("a", odd), ("b", 2.0)], "g string, v double")
    with pytest.raises(ValueError):
        quantiles.order_statistics(df, "v", {"k": lambda n: n}, ["g"])
    with pytest.raises(ValueError):
        quantiles.order_values(df, "v", lambda n: {"k": 0})


def test_ranking_quality_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 40, 400) / 40, rng.random(400) < 0.3
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean")
    r = metrics.ranking_quality(df, "s", F.col("y")).first()
    pos, neg = s[y], s[~y]
    auc = np.mean([(p > neg).sum() + 0.5 * (p == neg).sum() for p in pos]) / len(neg)
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        recall = (pos >= t).sum() / len(pos)
        ap += (recall - last) * (pos >= t).sum() / (s >= t).sum()
        last = recall
    assert r.roc_auc == pytest.approx(auc) and r.pr_auc == pytest.approx(ap)
    single = metrics.ranking_quality(df.where("y"), "s", F.col("y")).first()
    assert single.roc_auc is None and single.positives == y.sum()


def test_keep_first_absorbs_a_hot_key_before_the_shuffle(spark):
    rows = spark.range(6000).select(F.col("id").alias("row_id"), F.lit("GET").alias("http_method"), F.lit("").alias("url_query"),
                                    F.when(F.col("id") % 3 == 0, "/hot").otherwise(F.col("id").cast("string")).alias("url_path_raw"),
                                    F.lit(None).cast("string").alias("request_body"))
    first = dedup.keep_first(rows)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Partial") > plan.index("Final")
    assert first.count() == 4001 and first.where("url_path_raw = '/hot'").first().row_id == 0


def test_rank_in_group(spark):
    rows = [(g, f"s{i:04d}") for g, n in (("a", 700), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, s string").repartition(5)
    got = splits.rank_in_group(df, "g", "s").collect()
    assert all(r["rank"] == int(r.s[1:]) and r["size"] == (700 if r.g == "a" else 3) for r in got) and len(got) == 703


def flow(i, ip, ts):
    return (i, ip, ts, "crapi", "{}")


def test_first_campaign_wins_and_windows_are_closed(spark):
    campaigns = spark.createDataFrame([
        ("b.json", "B", "crapi", "attack", "sqli", "ffuf", "1", "2024-01-01T00:00:00.000Z", "2024-01-03T00:00:00.000Z"),
        ("a.json", "A", "crapi", "benign", None, None, "1", "2024-01-02T00:00:00.000Z", "2024-01-02T12:00:00.000Z"),
    ], "ord string, campaign_id string, app string, label string, attack_family string, attack_tool string, src_ip string, "
       "start_ts string, end_ts string")
    flows = spark.createDataFrame([
        flow(1, "1", "2024-01-01T00:00:00.000Z"), flow(2, "1", "2024-01-02T12:00:00.000Z"), flow(3, "1", "2024-01-03T00:00:00.000Z"),
        flow(4, "1", "2024-01-03T00:00:00.001Z"), flow(5, "2", "2024-01-02T00:00:00.000Z")],
        "row_id bigint, src_ip string, timestamp string, app string, headers string")
    got = {r.row_id: r.campaign_id for r in labelling.label_flows(flows, campaigns).collect()}
    assert got == {1: "B", 2: "A", 3: "B"}
    assert labelling.unmatched_flows(flows, campaigns).count() == 2
    with pytest.raises(ValueError):
        labelling.require_attributable(flows, campaigns)
    hourly = {r.row_id: r.campaign_id for r in labelling.label_flows(flows, campaigns, seconds=3600).collect()}
    assert hourly == got


@pytest.mark.parametrize("kind", ["temporal", "hash", "site"])
def test_no_request_has_two_roles(small, kind):
    if kind == "temporal":
        cut = splits.temporal_split(small.flows)
    elif kind == "hash":
        cut = splits.hash_split(small.flows)
    else:
        cut = splits.site_stratified_split(splits.with_time(dedup.keep_first(small.flows)).withColumn("site", X.site_key()))
    keyed = cut.withColumn("k", X.signature_key())
    membership.require_disjoint(keyed, "k", "role")
    assert {r.role for r in keyed.select("role").distinct().collect()} == {"train", "calib", "test"}


def test_require_disjoint_raises(spark):
    with pytest.raises(AssertionError):
        membership.require_disjoint(spark.createDataFrame([("k", "a"), ("k", "b")], "k string, side string"), "k", "side")


def test_quota_sample_has_the_exact_size(spark):
    rows = [(i, "f" + str(min(i % 7, 2))) for i in range(900)]
    sample = ranking.quota_sample(spark.createDataFrame(rows, "row_id bigint, f string"), "f", 100, "row_id")
    assert sample.count() == 100


def test_seeded_slices(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    sizes = {r.slice: r["count"] for r in ranking.seeded_slices(df, "row_id", ("calib", 50), ("train", 300)).groupBy("slice").count().collect()}
    assert sizes == {"calib": 50, "train": 300, None: 150}
    assert ranking.seeded_sample(df, 700, "row_id").count() == 500


def test_nearest_takes_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    q, t = rng.normal(size=(20, 5)), rng.normal(size=(60, 5))
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id bigint, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    expected = (unit(q) @ unit(t).T).max(axis=1)
    got = {r.query_id: r.similarity for r in neighbours.nearest_dense(frame(q), frame(t), "v", "id").collect()}
    assert [got[i] for i in range(20)] == pytest.approx(list(expected))
    mask_q, mask_t = np.abs(q) * (rng.random(q.shape) < 0.5), np.abs(t) * (rng.random(t.shape) < 0.5)
    sparse = lambda m: spark.createDataFrame([(i, [int(k) for k in np.nonzero(r)[0]], [float(x) for x in r[r > 0]]) for i, r in enumerate(m)],
                                             "id bigint, terms array<int>, weights array<double>")
    zero = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    expected = (zero(mask_q) @ zero(mask_t).T).max(axis=1)
    got = {r.query_id: r.similarity for r in neighbours.nearest_sparse(sparse(mask_q), sparse(mask_t), "id").collect()}
    assert [got[i] for i in range(20)] == pytest.approx(list(expected))


def _clustered(draw, clusters, size, dim, spread):
    centres = draw.normal(size=(clusters, dim))
    return (centres[:, None] + spread * draw.normal(size=(clusters, size, dim))).reshape(-1, dim)


def test_blocks_that_cannot_win_get_no_copy(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    draw = np.random.default_rng(12)
    train, queries = _clustered(draw, 30, 100, 24, .05), _clustered(np.random.default_rng(12), 30, 40, 24, .05)
    seen, met = [], neighbours._met

    def counted(visits, rows, kind):
        n = visits.groupBy("block").agg(F.ceil(F.count("*") / neighbours.BLOCK_ROWS).alias("groups"))
        seen.append(visits.count() + (rows.join(n, "block").agg(F.sum("groups")).first()[0] or 0))
        return met(visits, rows, kind)

    monkeypatch.setattr(neighbours, "_met", counted)
    frame = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id bigint, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {r.query_id: r.similarity for r in neighbours.nearest_dense(frame(queries), frame(train), "v", "id").collect()}
    expected = (unit(queries) @ unit(train).T).max(axis=1)
    assert len(got) == len(queries) and np.allclose([got[i] for i in range(len(queries))], expected)
    assert sum(seen) < len(queries) * len(train) / neighbours.BLOCK_ROWS / 4
    # Zero vectors, opposite vectors, nulls, no training rows.
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 1.0])], "id bigint, v array<double>")
    against = lambda *rows: {r.query_id: round(r.similarity, 9) for r in neighbours.nearest_dense(
        odd, spark.createDataFrame([(list(x),) for x in rows], "v array<double>"), "v", "id").collect()}
    assert against((-1.0, 0.0)) == {1: 0.0, 2: -1.0} and against((-1.0, 0.0), (0.0, 0.0)) == {1: 0.0, 2: 0.0}
    assert against((0.0, 0.0)) == {1: 0.0, 2: 0.0} and against() == {}


def test_sparse_rows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    draw = np.random.default_rng(13)
    base = draw.random((12, 300)) * (draw.random((12, 300)) < .15)
    near = lambda n: base[draw.integers(0, 12, n)] * (draw.random((n, 300)) < .9) + draw.random((n, 300)) * (draw.random((n, 300)) < .01)
    train, queries = near(300), np.vstack([near(120), np.zeros((1, 300))])
    rows = lambda m: spark.createDataFrame([(i, np.flatnonzero(x).tolist(), x[x != 0].tolist()) for i, x in enumerate(m)],
                                           "id bigint, terms array<int>, weights array<double>")
    got = {r.query_id: r.similarity for r in neighbours.nearest_sparse(rows(queries), rows(train), "id").collect()}
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    assert np.allclose([got[i] for i in range(len(queries))], (unit(queries) @ unit(train).T).max(axis=1))
    signed = train[:50] * draw.choice([-1, 1], (50, 300))
    both = neighbours._Postings(*neighbours._sparse(rows(signed).select("terms", "weights").toArrow()))
    found = both.best(*neighbours._sparse(rows(queries).select("terms", "weights").toArrow()))
    assert np.allclose(found, np.maximum(0, (unit(queries) @ unit(signed).T).max(axis=1)))


def test_metric_differences(spark):
    schema = "path string, value double, str string"
    e = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, None), ("c", None, "x"), ("d", 1.0, None)], schema)
    g = spark.createDataFrame([("a", 1.0000001, None), ("b", 2.1, None), ("c", None, "y"), ("e", 1.0, None)], schema)
    assert {r.path: r.difference for r in quality.metric_differences(e, g).collect()} == {
        "b": "value", "c": "value", "d": "missing", "e": "unexpected"}


def test_elementary_windows_match_brute_force():
    draw = np.random.default_rng(11)
    for _ in range(300):
        n = int(draw.integers(0, 12))
        spans = [(int(a), int(a + draw.integers(0, 15)), int(r), f"c{k}") for k, (a, r) in enumerate(zip(draw.integers(0, 40, n), draw.permutation(n)))]
        found = labelling.sweep(sorted(spans))
        assert all(a[1] < b[0] for a, b in zip(found, found[1:])) and all(a <= b for a, b, _ in found)
        for t in range(60):
            wins = min(((r, c) for a, b, r, c in spans if a <= t <= b), default=(None, None))[1]
            assert next((c for a, b, c in found if a <= t <= b), None) == wins


def _campaign_rows(spark, rows):
    return spark.createDataFrame(rows, "ord string, src_ip string, start_ts string, end_ts string").selectExpr(
        "*", "ord AS campaign_id", "'app' AS app", "'attack' AS label", "'sqli' AS attack_family", "'ffuf' AS attack_tool")


def _iso(us):
    import datetime
    return (datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=int(us))).strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"


@pytest.mark.parametrize("seconds,piece_rows", [(86_400, 1_000_000), (7, 3), (600, 20), (86_400, 5)])
def test_first_campaign_wins_in_any_slots_and_pieces(spark, seconds, piece_rows):
    draw = np.random.default_rng(seconds + piece_rows)
    spans = [(f"c{k:03d}", f"10.0.0.{draw.integers(3)}", int(a), int(a + draw.choice([0, 1, 5_000_000, 400_000_000, -1])))
             for k, a in enumerate(draw.integers(0, 300_000_000, 60))]
    at = [(i, f"10.0.0.{draw.integers(4)}", int(t)) for i, t in enumerate(np.append(draw.integers(0, 400_000_000, 300), [s[2] for s in spans] + [s[3] for s in spans]))]
    flows = spark.createDataFrame([(i, s, _iso(t)) for i, s, t in at] + [(-1, None, _iso(5)), (-2, "10.0.0.1", "bad"), (-3, "10.0.0.1", None)],
                                  "row_id long, src_ip string, timestamp string")
    got = {r.row_id: r.match.campaign_id if r.match else None for r in labelling.match_campaigns(
        flows, _campaign_rows(spark, [(o, s, _iso(a), _iso(b)) for o, s, a, b in spans]), seconds, piece_rows).collect()}
    expected = {i: min((o for o, s, a, b in spans if s == src and a <= t <= b), default=None) for i, src, t in at}
    assert got == expected | {-1: None, -2: None, -3: None}
    empty = labelling.match_campaigns(flows, _campaign_rows(spark, []))
    assert empty.where("match IS NULL").count() == len(at) + 3 == empty.count()
    assert labelling.match_campaigns(flows.limit(0), _campaign_rows(spark, [(o, s, _iso(a), _iso(b)) for o, s, a, b in spans])).isEmpty()


def test_a_hundred_thousand_campaigns_of_one_source_in_one_day(spark):
    n = 100_000
    campaigns = spark.range(n).selectExpr("lpad(id, 6, '0') AS ord", "'10.0.0.1' AS src_ip", "id * 500000 AS a", "id * 500000 + 2000000 AS b")
    stamp = "date_format(timestamp_micros(1704067200000000 + {}), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    campaigns = campaigns.selectExpr("ord", "src_ip", stamp.format("a") + " AS start_ts", stamp.format("b") + " AS end_ts", "ord AS campaign_id",
                                     "'app' AS app", "'attack' AS label", "'x' AS attack_family", "'y' AS attack_tool")
    flows = spark.range(50_000).selectExpr("id AS row_id", "'10.0.0.1' AS src_ip", stamp.format("id * 1000000 + 1") + " AS timestamp")
    matched = labelling.match_campaigns(flows, campaigns, piece_rows=20_000)
    plan = matched._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "_entries" not in plan
    # At a second s the open campaigns are those that began in the two seconds before: the first of them is 2 s - 3.
    assert matched.where("match.ord = lpad(greatest(2 * row_id - 3, 0), 6, '0')").count() == 50_000
    assert labelling._plan(flows.withColumn("_at", F.lit(1)), campaigns.withColumn("_start", F.lit(1)), 10 ** 12, 20_000).first().pieces == 8


def test_attack_pools_give_every_attack_a_role(spark, tmp_path):
    """More training payloads than the cap of 60 that once dropped the rest; a cap is still kept where one is asked for."""
    from wiretally.catalog.corpus_queries import attack_pools
    from wiretally.catalog.views import Tables
    spark.createDataFrame([(i, f"text {i // 2 if i < 10 else i}", "en", "src0") for i in range(300)],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 280)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' AS ts, id AS user_id, 'view' AS event_type, '{\"k\":\"1\"}' AS props FROM range(90)").write.parquet(
        f"{tmp_path}/events.parquet")
    found = {r.row_id: r.role for r in attack_pools(Tables(spark, str(tmp_path))).collect()}
    attacks = [i for i in range(300) if i < 280 or i % 5 == 0]
    assert {i for i in found if i >= 0} == {i for i in attacks if i >= 10 or i % 2 == 0}
    assert sum(found[i] == "train" for i in found if i >= 0) > 60
    assert {i for i in found if i < 0} == {-1 - i for i in range(0, 90, 3)}
    rows = Tables(spark, str(tmp_path)).posts.where("label = 'attack'")
    some = {r.row_id: r.role for r in splits.attack_pools(rows, train_cap=20, test_cap=None).collect()}
    assert list(some.values()).count("train") >= 20 and {i for i, r in some.items() if r == "test"} >= {i for i, r in found.items() if r == "test"}
