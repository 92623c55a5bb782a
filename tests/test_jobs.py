"""Every job end to end on a fifth of the flows, with few iterations."""

import pytest
from pyspark.sql import functions as F

from wiretally.functions import text as X
from wiretally.operators import dedup, membership, splits
from wiretally.plans import detector as D, jobs
from wiretally.sources.sinks import metrics_frame

QUICK = D.Settings(text_iterations=3, boosting_rounds=1, boosting_leaves=4, boosting_bins=16)
SIZES = splits.SliceSizes(200, 60, 150)


@pytest.fixture(scope="module")
def tables(spark):
    from wiretally.catalog.views import Tables
    return Tables(spark, "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def flows(tables):
    from wiretally.session import settle
    rows = tables.flows.where("row_id % 5 = 0").withColumns({"source_id": F.lit("testbed"), "session_id": F.col("src_ip"), "gt_rule": F.col("attack_family")})
    return settle(rows.repartition(2))


@pytest.fixture(scope="module")
def benign(flows):
    return flows.where("label = 'benign'")


@pytest.fixture(scope="module")
def attacks(flows):
    return flows.where("label = 'attack'")


@pytest.fixture(scope="module")
def pools(attacks):
    from wiretally.session import settle
    main = dedup.keep_first(attacks.where("row_id % 10 = 0")).withColumn("source_id", F.lit("main"))
    return settle(splits.attack_pools(main, attacks.where("row_id % 10 = 5"), train_cap=60, test_cap=40))


@pytest.fixture(scope="module")
def domain(benign, pools):
    return jobs.domain(benign, pools, settings=QUICK, sizes=SIZES)


def _is_rate(x):
    return x is None or 0 <= x <= 1


def test_domain(domain, spark):
    result, model, cut, thresholds = domain
    assert set(result["rates"]) == {"late_benign", "in_distribution", "cross_tool"}
    assert all(_is_rate(r) for s in result["rates"].values() for r in s["p_text"].values())
    calib = model.score(cut.where("role = 'calib'")).agg(
        F.avg((F.col("p_text") >= thresholds[0.05]).cast("double"))).first()[0]
    assert calib <= 0.05 + 2 / 60
    membership.require_disjoint(cut.withColumn("k", X.signature_key()), "k", "role")
    assert metrics_frame(spark, result).count() > 10


def test_hash_control_and_in_domain(benign, pools):
    assert jobs.domain(benign, pools, "hash", settings=QUICK, sizes=SIZES)[0]["split"] == "hash"
    result = jobs.in_domain(benign, pools, QUICK, splits.SliceSizes(200, 60, 150, None, False))
    assert set(result["corrected"]) == {0.01, 0.05}


def test_model_survives_saving(domain, tmp_path):
    _, model, cut, thresholds = domain
    model.save(str(tmp_path / "m"))
    again = D.TextModel.load(str(tmp_path / "m"))
    assert D.text_thresholds(again, cut.where("role = 'calib'")) == thresholds


def test_single_source(benign, attacks, flows):
    other = benign.where("user_id % 2 = 0")
    result = jobs.single_source(benign.where("user_id % 5 = 0"), attacks, benign.where("user_id % 2 = 1"), other, attacks, QUICK)
    assert set(result["rates"]) == {"heldout_benign", "attack", "testbed_test"}
    assert 0 <= result["roc_auc"] <= 1 and 0 <= result["pr_auc"] <= 1


def test_leave_one_out(flows):
    rows = flows.withColumn("source_id", F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string"))).withColumn("nature", F.lit("real"))
    sizes = splits.FoldSizes(60, 60, 80, 80, 0.3)
    result = jobs.leave_one_out(rows, [splits.Fold("s0", "s1"), splits.Fold("s2", "s3", "custom")], QUICK, sizes)
    assert list(result) == ["s0/s1", "s2/s3:custom"]
    assert all("heldout_benign" in r["rates"] for r in result.values())


def test_testbed(flows, tmp_path):
    result = jobs.testbed(flows, QUICK, families=["xss"])
    assert set(result["core"]) == set(jobs.ALL_CHANNELS)
    assert set(result["by_marker"]) <= {"marked", "marker_free"}


def test_learned_vs_rules(benign, pools, attacks):
    result = jobs.learned_vs_rules(benign, pools, attacks, QUICK, SIZES, families=["sqli"])
    overall = result["head_to_head"]["in_distribution"]["overall"]
    assert overall["n"] == sum(p["n"] for k, p in result["head_to_head"]["in_distribution"].items() if k != "overall")
    assert result["head_to_head"]["in_distribution"].get("marked", {"rule_recall": 1.0})["rule_recall"] == 1.0


def test_ablation(benign, pools, flows):
    result = jobs.ablation(benign, pools, flows, QUICK, SIZES)
    assert set(result["removed"]) <= {"brute_force", "bola_idor", "None"}  # None: last seen as benign
    assert set(result["content_only"]["rates"]) >= {"late_benign", "in_distribution"}


def test_mutation_robustness(domain, flows):
    _, model, _, thresholds = domain
    result = jobs.mutation_robustness(model, thresholds[0.01], flows, QUICK, per_family=20)
    assert {"original", "case", "double_url_encode"} <= set(result["aggregate"])


def test_further_domains(domain, flows, benign, pools):
    _, model, _, thresholds = domain
    result = jobs.further_domains(flows, benign, pools, model, thresholds, settings=QUICK, sizes=SIZES, stated_threshold=0.5)
    assert set(result["filing_cross_domain"]["rates"]) == {
        "filing@stated", "filing@own", "multi_tenant@stated", "multi_tenant@own"}


def test_multi_site(domain, benign, pools):
    result = jobs.multi_site(benign, pools, domain[1], settings=QUICK, sizes=SIZES)
    a = result["attribution"]
    assert a["covered_sites"] <= a["sites"]
    assert 0 < result["stratified"]["rows_from_trained_sites"] <= 1


def test_representation_coverage(domain, attacks):
    cut = domain[2]
    role = lambda r: cut.where(F.col("role") == r)
    result = jobs.representation_coverage(role("train"), role("calib"), role("test"), attacks, QUICK, 40, 40)
    assert result["n_target"] == 40 and 0 <= result["mean_distance"] <= 1
    assert set(result["by_budget"]) == {0.01, 0.05}


def test_family_sample(attacks, spark):
    keyed = attacks.withColumn("dec", X.decode(X.request_text()))
    firsts = dedup.first_per_key(keyed, ["http_method", "dec"]).orderBy("row_id").limit(30)
    labels = spark.createDataFrame(
        [(i, r.http_method, r.dec, r.attack_family) for i, r in enumerate(firsts.collect())],
        "row_index bigint, http_method string, dec string, family_label string")
    sample = jobs.rebuild_family_sample(labels, attacks)
    assert sample.count() == 30
    head = D.fit_family(attacks, QUICK)
    result = jobs.family_evaluation(sample, head)
    assert 0 <= result["accuracy"] <= 1 and result["agreement"]["n_fired"] >= 0
    with pytest.raises(AssertionError):
        jobs.rebuild_family_sample(labels.withColumn("dec", F.lit("nowhere")), attacks)


def test_build_corpus(tables):
    bare = tables.flows.where("row_id % 5 = 0").drop("label", "attack_family", "attack_tool")
    corpus, checks = jobs.build_corpus([bare.where("row_id % 10 = 0"), bare.where("row_id % 10 = 5")], tables.campaigns, True)
    outcome = {r.check_name: r.ok for r in checks.collect()}
    assert outcome["session_split_disjoint"] and outcome["zero_null_label"]
    assert corpus.count() > 0
    with pytest.raises(ValueError):
        jobs.build_corpus([bare], tables.campaigns)


def test_external_scoring(flows, benign):
    rows = flows.withColumn("y", (F.col("label") == "attack").cast("int"))
    cut = splits.session_split(rows)
    model = D.fit_detector(cut.where("split = 'train'"), cut.where("split <> 'train'"), QUICK)
    result = jobs.external_scoring(model, {"raw": benign, "attack": rows.where("y = 1")}, sample=50)
    assert result["raw"]["n"] == 50
