"""Named jobs: split, train, threshold, evaluate. Each takes request frames and returns a nested
dict of numbers (see ``sources.sinks.metrics_frame`` for the long table). Evaluation sets are
scored together and all their rates come from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wiretally.functions import hashing as H, rules, text as X
from wiretally.operators import dedup, labelling, membership, metrics, mutations, neighbours, quality, ranking, splits
from wiretally.plans import detector as D
from wiretally.schema import CONTENT_FAMILIES, MODEL_FIELDS
from wiretally.session import settle, spread_out, tabled

REQUEST = [c for c in MODEL_FIELDS if c != "label"]
TEXT_ONLY = ("p_text",)
ALL_CHANNELS = ("p_text", "p_numeric", "p_content")


# --- shared steps ----------------------------------------------------------------------------

def _sets(sets: dict[str, DataFrame | None], *keep: str) -> DataFrame:
    """What is to be scored, by ``evaluation_set``, dealt out evenly."""
    out = None
    for name, df in sets.items():
        if df is not None:
            part = df.select(*REQUEST, *[c for c in keep if c in df.columns]).withColumn("evaluation_set", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return None if out is None else spread_out(out)


def _rates(scored: DataFrame, thresholds: dict[str, dict[float, float]]) -> dict:
    """``{set: {channel: {budget: rate}}}`` plus ``{set: {"n": rows}}``."""
    cases = [(c, a, t) for c, per in thresholds.items() for a, t in per.items()]
    out: dict = {}
    for r in metrics.alert_rates(scored, cases).collect():  # sets x channels x budgets rows
        entry = out.setdefault(r.evaluation_set, {"n": r.n})
        entry.setdefault(r.channel, {})[r.budget] = r.alert_rate
    return out


def review(scored: DataFrame, score: str, threshold: float, n: int = 100,
           pattern: str = rules.DECODED_MARKERS, decoded: bool = True, tie: str = "row_id") -> DataFrame:
    """The top alerts with ``marked``: does the request carry an audit marker?"""
    top = ranking.top_alerts(scored, score, threshold, n, tie)
    text = X.decode(X.request_text()) if decoded else X.request_text()
    return top.withColumn("marked", rules.matches(text, pattern))


def _reviewed(top: DataFrame, empty_share: float = 1.0) -> dict:
    r = top.agg(F.count("*").alias("n"), F.count_if("marked").alias("m")).first()
    return {"n_top": r.n, "marked": r.m, "true_fp": r.n - r.m,
            "true_fp_share": (r.n - r.m) / r.n if r.n else empty_share}


def _split(benign: DataFrame, kind: str, sizes: splits.SliceSizes) -> DataFrame:
    """Capped slices, written once: every later step reads them again."""
    cut = splits.temporal_split(benign, sizes=sizes) if kind == "temporal" else splits.hash_split(benign, sizes=sizes)
    return settle(cut, spread=True)


def _require_apart(train: DataFrame, held: DataFrame) -> None:
    """No request of ``held`` occurs in ``train``; only digests are compared."""
    key = X.signature_key().alias("key")
    membership.require_disjoint(train.select(key, F.lit("train").alias("side")).unionByName(held.select(key, F.lit("held").alias("side"))), "key", "side")


def _role(df: DataFrame, role: str) -> DataFrame:
    return df.where(F.col("role") == role)


def marker_free_sample(attacks: DataFrame, total: int = 100, family: str = "attack_family") -> DataFrame:
    """Attacks on which no rule fires, sampled over families in proportion, with review texts."""
    decoded = attacks.withColumn("decoded", X.decode(X.request_text()))
    free = decoded.where(~rules.any_rule(F.col("decoded")))
    drawn = ranking.quota_sample(free, family, total, "row_id")
    return drawn.withColumns({c: X.review_text(c) for c in ("request_body", "headers", "decoded")})


# --- one domain ------------------------------------------------------------------------------

def domain(benign: DataFrame, pools: DataFrame, kind: str = "temporal", extra: dict[str, DataFrame] | None = None,
           settings: D.Settings = D.Settings(), sizes: splits.SliceSizes = splits.SliceSizes(),
           reference: float | None = None) -> tuple[dict, D.TextModel, DataFrame, dict[float, float]]:
    """One text model on a domain's own benign traffic: alert rate on its later traffic, recall on
    held-out attacks. Returns the numbers, the model, the slices and the thresholds."""
    cut, pools = _split(benign, kind, sizes), settle(pools, spread=True)
    train = membership.concat_classes(_role(cut, "train"), _role(pools, "train"))
    model = D.fit_text(train, settings)
    thresholds = D.text_thresholds(model, _role(cut, "calib"))
    late = _role(cut, "test")
    scored = model.score(_sets({"late_benign": late, "in_distribution": _role(pools, "test"),
                                "cross_tool": _role(pools, "tool_test"), **(extra or {})}, "row_id"))
    scored = scored.persist()
    rates = _rates(scored, {"p_text": thresholds})
    seen = _reviewed(review(scored.where(F.col("evaluation_set") == "late_benign"), "p_text", thresholds[D.PRIMARY]))
    scored.unpersist()
    sizes_ = {r.role: r["count"] for r in cut.groupBy("role").count().collect()}
    late_rates = rates.get("late_benign", {}).get("p_text", {})
    result = {"split": kind, "rows": sizes_, "thresholds": thresholds, "rates": rates, "review": seen,
              "corrected": {a: r * seen["true_fp_share"] for a, r in late_rates.items()}, "reference": reference}
    return result, model, cut, thresholds


def multi_domain(domains: dict[str, DataFrame], pools: DataFrame, **options) -> dict:
    """The same protocol on each deployment domain."""
    return {name: domain(benign, pools, **options)[0] for name, benign in domains.items()}


def in_domain_slices(benign: DataFrame, pools: DataFrame, sizes: splits.SliceSizes) -> tuple[DataFrame, DataFrame]:
    """Benign slices (train first) and attack pools without the hashed 15 % kept from the fit."""
    cut, pools = settle(splits.temporal_split(benign, sizes=sizes), spread=True), settle(pools, spread=True)
    kept = ranking.fraction(_role(pools, "train"), 0.15, X.signature(), "_out").where(~F.col("_out")).drop("_out")
    return cut, kept.unionByName(pools.where(F.col("role") != "train"))


def in_domain(benign: DataFrame, pools: DataFrame, settings: D.Settings = D.Settings(),
              sizes: splits.SliceSizes = splits.IN_DOMAIN_SIZES) -> dict:
    """Early traffic trains, later traffic of the same domain tests."""
    cut, attacks = in_domain_slices(benign, pools, sizes)
    model = D.fit_text(membership.concat_classes(_role(cut, "train"), _role(attacks, "train")), settings)
    thresholds = D.text_thresholds(model, _role(cut, "calib"))
    scored = model.score(_sets({"late_benign": _role(cut, "test"), "in_distribution": _role(attacks, "test"),
                                "cross_tool": _role(attacks, "tool_test")}, "row_id")).persist()
    rates = _rates(scored, {"p_text": thresholds})
    top = review(scored.where(F.col("evaluation_set") == "late_benign"), "p_text", thresholds[D.PRIMARY],
                 pattern=rules.ALERT_MARKERS, decoded=False)
    seen = _reviewed(top, empty_share=0.0)
    scored.unpersist()
    late = rates.get("late_benign", {}).get("p_text", {})
    return {"thresholds": thresholds, "rates": rates, "review": seen,
            "corrected": {a: r * seen["true_fp_share"] for a, r in late.items()}}


# --- one source against another --------------------------------------------------------------

def single_source(testbed_benign: DataFrame, testbed_attacks: DataFrame, real_benign: DataFrame, test_benign: DataFrame,
                  test_attacks: DataFrame, settings: D.Settings = D.Settings()) -> dict:
    """Real benign of one source in training, another source as the false-positive test."""
    payloads = splits.payload_split(testbed_attacks)
    real = settle(splits.benign_split(real_benign))
    novel = settle(membership.exclude_seen(dedup.keep_first(test_benign), _role(real, "train")))
    _require_apart(_role(real, "train"), novel)
    train = membership.concat_classes(
        testbed_benign.select(*REQUEST).unionByName(_role(real, "train").select(*REQUEST)),
        _role(payloads, "fit").select(*REQUEST))
    calib = membership.concat_classes(_role(real, "calib").select(*REQUEST), _role(payloads, "calib").select(*REQUEST))
    model = D.fit_detector(train, calib, settings)
    scored = settle(model.score(_sets({"heldout_benign": novel, "attack": test_attacks,
                                       "testbed_test": _role(payloads, "test")}, "row_id")))
    real_sets = scored.where(F.col("evaluation_set").isin("heldout_benign", "attack"))
    quality_ = metrics.ranking_quality(real_sets, "p_content", F.col("evaluation_set") == "attack").first()
    top = review(scored.where(F.col("evaluation_set") == "heldout_benign"), "p_content", model.threshold(),
                 pattern=rules.ALERT_MARKERS, decoded=False)
    return {"thresholds": model.thresholds, "rates": _rates(scored, model.thresholds),
            "roc_auc": quality_.roc_auc, "pr_auc": quality_.pr_auc, "review": _reviewed(top)}


def single_source_directions(testbed_benign: DataFrame, testbed_attacks: DataFrame, sources: dict[str, tuple[DataFrame, DataFrame]],
                             settings: D.Settings = D.Settings()) -> dict:
    """``single_source`` for each ordered pair of sources (benign, attacks): benign of one in training, the other one as the test."""
    return {f"{a}_to_{b}": single_source(testbed_benign, testbed_attacks, sources[a][0], *sources[b], settings)
            for a in sources for b in sources if a != b}


def leave_one_out(requests: DataFrame, folds: Sequence[splits.Fold], settings: D.Settings = D.Settings(),
                  sizes: splits.FoldSizes = splits.FoldSizes()) -> dict:
    """Whole sources held out per fold: alert rate on one, recall on the other."""
    roles = settle(splits.leave_one_source_out(requests, folds, sizes))
    side = F.when(F.col("role").startswith("heldout"), "heldout").otherwise("training")
    membership.require_disjoint(roles.select(F.concat_ws("|", "fold", "signature_key").alias("key"), side.alias("side")), "key", "side")
    out = {}
    for fold in folds:
        mine = roles.where(F.col("fold") == fold.name).select("source_id", "row_id", "role")
        rows = settle(requests.join(mine, ["source_id", "row_id"]).withColumn(
            "y", (F.col("label") == "attack").cast("int")), spread=True)
        model = D.fit_detector(_role(rows, "fit"), _role(rows, "calib"), settings)
        scored = settle(model.score(_sets({"heldout_benign": _role(rows, "heldout_benign"),
                                           "heldout_attack": _role(rows, "heldout_attack")}, "row_id")))
        top = review(scored.where(F.col("evaluation_set") == "heldout_benign"), "p_content", model.threshold(),
                     pattern=rules.ALERT_MARKERS, decoded=False)
        counts = {f"{r.role}_{r.label}": r["count"] for r in rows.groupBy("role", "label").count().collect()}
        out[fold.name] = {"rows": counts, "rates": _rates(scored, {c: model.thresholds[c] for c in ("p_text", "p_content")}),
                          "review": _reviewed(top)}
    return out


# --- testbed ---------------------------------------------------------------------------------

def _tool_pairs(df: DataFrame, family: str, shared: bool) -> DataFrame:
    rows = df.where(F.col("attack_family") == family)
    return membership.drop_shared_payloads(rows, X.decode(X.request_text()), "attack_tool", "custom", "ffuf") if shared else rows


# Families with a clean cross-tool holdout, and those that first lose shared payloads.
CLEAN_FAMILIES = ["sqli", "xss", "cmd_injection", "ssti"]
SHARED_FAMILIES = ["path_traversal", "scan"]


def testbed(df: DataFrame, settings: D.Settings = D.Settings(), families: Sequence[str] | None = None) -> dict:
    """Session-stratified core evaluation, cross-tool holdouts, marked against marker-free recall
    and the family head. ``df`` has ``row_id``."""
    assignment = splits.stratified_session_split(df)
    rows = settle(membership.assign(df, assignment, "session_id").withColumnRenamed("split", "role").withColumn(
        "y", (F.col("label") == "attack").cast("int")), spread=True)
    membership.require_disjoint(rows, "session_id", "role")
    model = D.fit_detector(_role(rows, "train"), _role(rows, "calib"), settings)
    scored = settle(model.score(_role(rows, "test")))
    y = F.col("y") == 1
    core: dict = {}
    for channel in ALL_CHANNELS:
        curve = metrics.ranking_quality(scored, channel, y).first()
        core[channel] = {"roc_auc": curve.roc_auc, "pr_auc": curve.pr_auc} | {
            a: metrics.threshold_metrics(scored, channel, y, t).first().asDict()
            for a, t in model.thresholds[channel].items()}
    attacks = scored.where(y).withColumn("evaluation_set", F.when(
        rules.matches(X.request_text(), rules.INJECTION_MARKERS), "marked").otherwise("marker_free"))
    head = D.fit_family(_role(rows, "train").where(y), settings)
    report = metrics.class_report(head.predict(_role(rows, "test").where(y)), "attack_family", "pred_family")
    return {"core": core, "cross_tool": cross_tool(df, settings, families),
            "by_marker": _rates(attacks, {c: {D.PRIMARY: model.thresholds[c][D.PRIMARY]} for c in ALL_CHANNELS}),
            "family_head": {r.label: r.asDict() for r in report.collect()}}


def cross_tool(df: DataFrame, settings: D.Settings = D.Settings(), families: Sequence[str] | None = None,
               tools: Sequence[str] = ("ffuf", "sqlmap"), held: str = "custom") -> dict:
    """Train on the attacks of some tools, test on another's, in both directions, per family."""
    benign = settle(splits.session_split(df.where(F.col("label") == "benign")))
    part = lambda s: benign.where(F.col("split") == s)
    out: dict = {}
    for family in families or CLEAN_FAMILIES + SHARED_FAMILIES:
        pairs = settle(splits.tool_holdout(_tool_pairs(df, family, family in SHARED_FAMILIES), tools, held))
        for direction in ("A_to_B", "B_to_A"):
            d = pairs.where(F.col("direction") == direction)
            if d.isEmpty():
                out.setdefault(family, {})["skipped"] = True
                continue
            model = D.fit_detector(membership.concat_classes(part("train"), _role(d, "fit")),
                                   membership.concat_classes(part("calib"), _role(d, "calib")), settings)
            scored = model.score(_sets({"heldout": _role(d, "heldout"), "benign": part("test")}))
            out.setdefault(family, {})[direction] = _rates(scored, {"p_content": {D.PRIMARY: model.threshold()}})
    return out


def external_scoring(model: D.Detector, sets: dict[str, DataFrame], sample: int | None = None) -> dict:
    """A stored detector over raw traffic, repeats included: rate per set at its own threshold."""
    drawn = {n: (ranking.seeded_sample(df, sample, "row_id") if sample else df) for n, df in sets.items()}
    return _rates(model.score(_sets(drawn)), {"p_content": {D.PRIMARY: model.threshold()}})


# --- learned against rules, ablation ---------------------------------------------------------

def learned_vs_rules(benign: DataFrame, pools: DataFrame, testbed_attacks: DataFrame, settings: D.Settings = D.Settings(),
                     sizes: splits.SliceSizes = splits.IN_DOMAIN_SIZES, families: Sequence[str] | None = None,
                     disjoint_calibration: bool = True) -> dict:
    """Text model against the rule baseline, cross-tool recall at the deployed budget, and text
    only against fused. ``disjoint_calibration=False`` calibrates the fusion on fitted attacks."""
    cut, attacks = in_domain_slices(benign, pools, sizes)
    fit = membership.concat_classes(_role(cut, "train"), _role(attacks, "train"))
    model = D.fit_text(fit, settings)
    thresholds = D.text_thresholds(model, _role(cut, "calib"))
    sets = {"late_benign": _role(cut, "test"), "in_distribution": _role(attacks, "test"), "cross_tool": _role(attacks, "tool_test")}
    scored = settle(model.score(_sets(sets)).withColumn("rule", rules.any_rule(X.decode(X.request_text()))))
    head_to_head = {}
    for name in sets:
        rows = scored.where(F.col("evaluation_set") == name)
        parts = metrics.recall_by_marker(rows, F.col("p_text") >= thresholds[D.PRIMARY], F.col("rule"))
        head_to_head[name] = {r.part: r.asDict() for r in parts.collect()}
    by_family: dict = {}
    for family in families or CLEAN_FAMILIES + SHARED_FAMILIES:
        pairs = settle(splits.tool_holdout(_tool_pairs(testbed_attacks, family, family in SHARED_FAMILIES), ["ffuf", "sqlmap"], "custom"))
        for direction in ("A_to_B", "B_to_A"):
            d = pairs.where(F.col("direction") == direction)
            if d.isEmpty():
                by_family.setdefault(family, {})["skipped"] = True
                continue
            probe = D.fit_text(membership.concat_classes(_role(cut, "train"), d.where(F.col("role") != "heldout")), settings)
            own = D.text_thresholds(probe, _role(cut, "calib"))
            found = probe.score(_sets({"heldout": _role(d, "heldout"), "calib_benign": _role(cut, "calib")}))
            by_family.setdefault(family, {})[direction] = _rates(found, {"p_text": {D.PRIMARY: own[D.PRIMARY]}})
    marked = ranking.fraction(_role(attacks, "train"), 0.15, X.signature(), "_cal")
    calib_atk = marked.where("_cal").drop("_cal")
    fit_atk = marked.where(~F.col("_cal")).drop("_cal") if disjoint_calibration else _role(attacks, "train")
    fused = D.fit_detector(membership.concat_classes(_role(cut, "train"), fit_atk),
                           membership.concat_classes(_role(cut, "calib"), calib_atk), settings)
    fused_rates = _rates(fused.score(_sets(sets)), {"p_content": {D.PRIMARY: fused.threshold()}})
    return {"head_to_head": head_to_head, "cross_tool": by_family,
            "text_only": _rates(scored, {"p_text": {D.PRIMARY: thresholds[D.PRIMARY]}}), "fused": fused_rates}


def ablation(benign: DataFrame, pools: DataFrame, labelled: DataFrame, settings: D.Settings = D.Settings(),
             sizes: splits.SliceSizes = splits.IN_DOMAIN_SIZES, extra: dict[str, DataFrame] | None = None) -> dict:
    """All testbed families among the positives against content families only. ``pools`` has
    ``source_id``; families come back from the labelled table by signature."""
    cut, attacks = in_domain_slices(benign, pools, sizes)
    fit = membership.recover_family(_role(attacks, "train"), labelled)
    is_testbed, content = F.col("source_id") == "testbed", F.col("attack_family").isin(CONTENT_FAMILIES)
    keep = ~is_testbed | F.coalesce(content, F.lit(False))
    tool_test = membership.recover_family(_role(attacks, "tool_test"), labelled)
    own = F.coalesce(content, F.lit(False))
    sets = {"late_benign": _role(cut, "test"), "in_distribution": _role(attacks, "test"),
            "tool_content": tool_test.where(own), "tool_other": tool_test.where(~own), **(extra or {})}
    removed = fit.where(~keep).groupBy("attack_family").count().collect()
    out: dict = {"removed": {str(r.attack_family): r["count"] for r in removed}}
    for name, positives in (("all_families", fit), ("content_only", fit.where(keep))):
        model = D.fit_text(membership.concat_classes(_role(cut, "train"), positives), settings)
        thresholds = D.text_thresholds(model, _role(cut, "calib"))
        out[name] = {"thresholds": thresholds, "rates": _rates(model.score(_sets(sets)), {"p_text": thresholds})}
    return out


# --- payload rewrites ------------------------------------------------------------------------

def mutation_robustness(model: D.TextModel, threshold: float, testbed: DataFrame, settings: D.Settings = D.Settings(),
                        per_family: int | None = None, tool: str = "custom", disjoint_threshold: bool = True) -> dict:
    """Recall on held-out payloads and on each rewrite of them, for the deployed model, for a probe
    trained on the testbed (with and without decoding) and for the rules; per family and as the
    mean over families."""
    benign = ranking.fraction(testbed.where(F.col("label") == "benign"), 0.2, "row_id", "_cal")
    fit_benign = benign.where(~F.col("_cal")) if disjoint_threshold else benign
    others = testbed.where((F.col("label") == "attack") & ~F.coalesce(F.col("attack_tool") == tool, F.lit(False)))
    probe = D.fit_text(membership.concat_classes(fit_benign.select(*REQUEST), others.select(*REQUEST)), settings)
    probe_threshold = D.text_thresholds(probe, benign.where("_cal"))[D.PRIMARY]
    held = testbed.where((F.col("label") == "attack") & (F.col("attack_tool") == tool)
                         & F.col("attack_family").isin(mutations.FAMILIES))
    payloads = ranking.first_distinct(
        held.select("row_id", "attack_family", X.decode(X.strip(X.request_text())).alias("payload")),
        "payload", "attack_family", per_family)
    rewritten = settle(mutations.mutate(payloads))
    as_request = rewritten.withColumns({"url_path_raw": F.col("mutated"), "http_method": F.lit(""), "url_query": F.lit(""),
                                        "request_body": F.lit(""), "headers": F.lit("")})
    scored = probe.score_raw(probe.score(model.score(as_request, "deployed"), "probe"), "mutated", "probe_nodecode")
    hits = scored.select("attack_family", "mutation", (F.col("deployed") >= threshold).alias("deployed"),
                         (F.col("probe") >= probe_threshold).alias("probe"),
                         (F.col("probe_nodecode") >= probe_threshold).alias("probe_nodecode"),
                         rules.any_rule(X.decode("mutated")).alias("regex"))
    channels = ("deployed", "probe", "probe_nodecode", "regex")
    per = settle(hits.groupBy("mutation", "attack_family").agg(
        F.count("*").alias("n"), *[metrics.share(F.col(c)).alias(c) for c in channels]))
    overall = per.groupBy("mutation").agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in channels])
    return {"probe_threshold": probe_threshold,
            "per_family": {f"{r.mutation}/{r.attack_family}": r.asDict() for r in per.collect()},
            "aggregate": {r.mutation: r.asDict() for r in overall.collect()}}


# --- further domains, sites, coverage --------------------------------------------------------

def further_domains(multi_tenant: DataFrame, filing: DataFrame, pools: DataFrame, deployed: D.TextModel,
                    deployed_thresholds: dict[float, float], extra: dict[str, DataFrame] | None = None,
                    settings: D.Settings = D.Settings(), sizes: splits.SliceSizes = splits.SliceSizes(), *, stated_threshold: float) -> dict:
    """A multi-tenant host (temporal split, hash control, its own rule-labelled attacks) and a
    benign-only filing server (scored by the deployed model, then in its own domain)."""
    benign = multi_tenant.where(F.col("label") == "benign")
    own = multi_tenant.where(F.col("label") == "attack")
    result, model, _, thresholds = domain(benign, pools, "temporal", {**(extra or {}), "own_attacks": own}, settings, sizes)
    by_rule = model.score(spread_out(own)).groupBy("gt_rule").agg(
        F.count("*").alias("n"), metrics.share(F.col("p_text") >= thresholds[D.PRIMARY]).alias("recall"))
    control = domain(benign, pools, "hash", None, settings, sizes)[0]
    cross = settle(deployed.score(_sets({"filing": filing, "multi_tenant": benign}, "row_id")))
    stated = {"stated": stated_threshold, "own": deployed_thresholds[D.PRIMARY]}
    seen = _reviewed(review(cross.where(F.col("evaluation_set") == "filing"), "p_text", stated_threshold, 50))
    cases = [("p_text", i, t) for i, t in enumerate(stated.values())]
    names = list(stated)
    rates = {f"{r.evaluation_set}@{names[int(r.budget)]}": r.alert_rate for r in metrics.alert_rates(cross, cases).collect()}
    return {"multi_tenant": result | {"recall_by_rule": {r.gt_rule: r.asDict() for r in by_rule.collect()}, "hash_control": control},
            "filing_cross_domain": {"rates": rates, "review": seen},
            "filing": domain(filing, pools, "temporal", extra, settings, sizes)[0]}


def sited_benign(benign: DataFrame, least: int = 50) -> DataFrame:
    """Benign rows with ``ts`` and ``site``; rare sites share one bucket."""
    timed = splits.with_time(benign).withColumn("site", X.site_key())
    return ranking.collapse_small(timed, "site", least)


def multi_site(benign: DataFrame, pools: DataFrame, model: D.TextModel, extra: dict[str, DataFrame] | None = None,
               settings: D.Settings = D.Settings(), sizes: splits.SliceSizes = splits.SliceSizes()) -> dict:
    """Which sites the alerts of the temporal split come from, and the same domain with the split
    stratified by site."""
    sited = settle(sited_benign(benign))
    boundary = splits.temporal_boundary(dedup.keep_first(sited))
    cut = settle(splits.temporal_split(sited, sizes=sizes, boundary=boundary), spread=True)
    threshold = D.text_thresholds(model, _role(cut, "calib"))[D.PRIMARY]
    late = model.score(_role(cut, "test")).withColumn("alert", F.col("p_text") >= threshold)
    first_seen = sited.groupBy("site").agg(F.min("ts").alias("first_seen"))
    per_site = settle(metrics.site_attribution(
        late, _role(cut, "train"), first_seen, F.timestamp_micros(F.lit(int(boundary)))))
    stratified = settle(splits.site_stratified_split(dedup.keep_first(sited), sizes=sizes), spread=True)
    membership.require_disjoint(stratified.select(X.signature_key().alias("key"), "role"), "key", "role")
    fit = membership.concat_classes(_role(stratified, "train"), _role(pools, "train"))
    again = D.fit_text(fit, settings)
    thresholds = D.text_thresholds(again, _role(stratified, "calib"))
    covered = membership.mark_members(_role(stratified, "test"), _role(stratified, "train"), "site", "known")
    scored = again.score(_sets({"late_benign": _role(stratified, "test"), "in_distribution": _role(pools, "test"),
                                "cross_tool": _role(pools, "tool_test"), **(extra or {})}))
    return {"attribution": metrics.coverage_summary(per_site).first().asDict(),
            "top_sites": [r.asDict() for r in metrics.top_sites(per_site).collect()],
            "stratified": {"rates": _rates(scored, {"p_text": thresholds}),
                           "rows_from_trained_sites": covered.agg(metrics.share(F.col("known"))).first()[0]}}


def representation_coverage(train: DataFrame, calib: DataFrame, target: DataFrame, attacks: DataFrame,
                            settings: D.Settings = D.Settings(), n_target: int | None = None, n_calib: int | None = None) -> dict:
    """Distance of target requests to the training set in the model's own space, and whether the
    alert rate stays within the share outside the calibration radius."""
    model = D.fit_text(membership.concat_classes(train.select(*REQUEST), attacks.select(*REQUEST)), settings)
    thresholds = D.text_thresholds(model, calib)
    known = model.terms(train.select(*REQUEST)).select("terms", "weights")

    def measured(df: DataFrame, n: int | None) -> DataFrame:
        rows = settle(df if n is None else ranking.seeded_sample(df, n, "row_id"), spread=True)
        near = neighbours.nearest_sparse(model.terms(rows).select("row_id", "terms", "weights"), known, "row_id")
        scored = model.score(rows).select(F.col("row_id").alias("query_id"), F.col("p_text").alias("score"))
        return settle(near.join(scored, "query_id").withColumn("distance", 1 - F.col("similarity")))

    at_calib, at_target = measured(calib, n_calib), measured(target, n_target)
    rows = neighbours.coverage(at_calib, at_target, thresholds).collect()
    mean = at_target.agg(F.avg("distance")).first()[0]
    return {"n_target": at_target.count(), "mean_distance": mean, "by_budget": {r.budget: r.asDict() for r in rows}}


def representation_pairs(pairs: dict[str, tuple[DataFrame, DataFrame, DataFrame, DataFrame]], settings: D.Settings = D.Settings(), **sizes) -> dict:
    """``representation_coverage`` of several (train, calib, target, attacks): domains against each other, folds that leave a source out."""
    return {name: representation_coverage(*frames, settings, **sizes) for name, frames in pairs.items()}


# --- family sample ---------------------------------------------------------------------------

def rebuild_family_sample(labels: DataFrame, attacks: DataFrame) -> DataFrame:
    """Requests of the reviewed rows (row_index, http_method, dec, family_label): the first
    occurrence of each decoded text, checked to decode back row for row."""
    keyed = attacks.withColumn("dec", X.decode(X.request_text()))
    found = settle(dedup.first_occurrence(keyed, labels, ["http_method", "dec"]))
    missing = found.where(~F.col("found")).count()
    if missing:
        raise AssertionError(f"{missing} reviewed rows have no request")
    sample = found.select("row_index", "row_id", "family_label").join(attacks.drop("http_method"), "row_id").join(
        labels.select("row_index", "http_method"), "row_index")
    if not quality.decode_mismatches(sample, labels).isEmpty():
        raise AssertionError("decoded texts differ from the reviewed table")
    return sample


def family_evaluation(sample: DataFrame, head: D.FamilyHead) -> dict:
    """Reviewed labels against the rules as a second annotator, and the family head on them."""
    hits = rules.rule_hits(X.decode(X.request_text()))
    agreement = metrics.annotator_agreement(sample, hits, F.col("family_label")).first()
    predicted = settle(head.predict(sample, X.family_text()))
    report = metrics.class_report(predicted, "family_label", "pred_family", empty=None)
    accuracy = predicted.agg(metrics.share(F.col("family_label") == F.col("pred_family"))).first()[0]
    return {"agreement": agreement.asDict(), "accuracy": accuracy,
            "per_family": {r.label: r.asDict() for r in report.collect()}}


# --- corpus build ----------------------------------------------------------------------------

def build_corpus(captures: Sequence[DataFrame], campaigns: DataFrame, allow_unmatched: bool = False,
                 seed: int = H.SEED) -> tuple[DataFrame, DataFrame]:
    """Label the captures, put them together, split by session and check. Returns the split
    corpus and its checks."""
    labelled, campaigns = None, tabled(campaigns, "campaigns")
    for capture in captures:
        if not allow_unmatched:
            labelling.require_attributable(capture, campaigns)
        part = labelling.label_flows(capture, campaigns)
        labelled = part if labelled is None else labelled.unionByName(part, allowMissingColumns=True)
    corpus = settle(splits.session_split(labelled, seed=seed))
    bare = corpus.drop("attack_family", "attack_tool", "campaign_id", "label_source")
    checks = (quality.row_checks(corpus).unionByName(quality.benign_purity(bare, campaigns))
              .unionByName(quality.family_checks(corpus)).unionByName(quality.split_disjoint(corpus)))
    return corpus, checks
