"""Leakage-safe splitters. Each returns its rows with a role; no key ever has two roles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wiretally.functions import clock, hashing as H, text as X
from wiretally.operators.dedup import keep_first
from wiretally.operators.quantiles import group_quantile_linear, order_values, quantile_linear, smallest
from wiretally.operators.ranking import place, seeded_sample, slice_cuts
from wiretally.schema import BEHAVIOURAL_FAMILIES, CONTENT_FAMILIES, CONTEXT_FAMILIES, SIGNATURE_FIELDS
from wiretally.session import settle

# Which split a content tool or a context family belongs to.
CONTENT_TOOL_SPLIT = {"ffuf": "train", "sqlmap": "train", "custom": "test"}
CONTEXT_SPLIT = {"bola_idor": "train", "mass_assignment": "calib", "business_logic_abuse": "test"}


def three_way(key: Column, train: float = 0.6, calib: float = 0.2, seed: int = H.SEED) -> Column:
    """``train`` / ``calib`` / ``test`` from the hash of a key."""
    h = H.unit(key, seed)
    return F.when(h < train, "train").when(h < train + calib, "calib").otherwise("test")


def session_split(df: DataFrame, session: str = "session_id", seed: int = H.SEED) -> DataFrame:
    return df.withColumn("split", three_way(F.col(session), seed=seed))


def session_summary(df: DataFrame, session: str = "session_id", order: str = "row_id") -> DataFrame:
    """First label, family set and first known tool per session."""
    return df.groupBy(session).agg(
        F.min_by("label", order).alias("label"),
        F.sort_array(F.collect_set("attack_family")).alias("families"),
        F.min_by("attack_tool", F.when(F.col("attack_tool").isNotNull(), F.col(order))).alias("tool"))


def rank_in_group(df: DataFrame, group: str, order: str) -> DataFrame:
    """Exact 0-based ``rank`` and group ``size`` in the order of a column of any type. Rows are
    range-partitioned on (group, order), so one large group spans many tasks; a row's rank is its
    place in its partition plus what the group has in earlier partitions. The ranged rows are
    checkpointed because their partition numbers must not change between the two uses."""
    ranged = settle(df.repartitionByRange(F.col(group), F.col(order))
                    .sortWithinPartitions(group, order)
                    .withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    runs = ranged.groupBy(group, "_pid").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    w = W.partitionBy(group)
    runs = runs.withColumns({"_ahead": F.sum("_n").over(w.orderBy("_pid")) - F.col("_n"),
                             "size": F.sum("_n").over(w)})
    return (ranged.join(runs, [group, "_pid"])
            .withColumn("rank", F.col("_at") - F.col("_start") + F.col("_ahead"))
            .drop("_pid", "_at", "_start", "_n", "_ahead"))


def stratified_session_split(df: DataFrame, session: str = "session_id", order: str = "row_id") -> DataFrame:
    """``session -> split``: benign and mixed sessions by hash, content sessions by tool,
    behavioural ones 60/20/20 of the sorted sessions of a family, context ones by family."""
    s = session_summary(df, session, order)
    only = F.when(F.size("families") == 1, F.get("families", F.lit(0)))
    content = F.size(F.array_except("families", F.array(*map(F.lit, CONTENT_FAMILIES)))) == 0
    by_tool, by_context = F.lit(None).cast("string"), F.lit(None).cast("string")
    for tool, split in CONTENT_TOOL_SPLIT.items():
        by_tool = F.when(F.col("tool") == tool, split).otherwise(by_tool)
    for family, split in CONTEXT_SPLIT.items():
        by_context = F.when(only == family, split).otherwise(by_context)
    hashed = three_way(F.col(session))
    plain = (F.col("label") == "benign") | (F.size("families") == 0)
    s = s.withColumn("_kind", F.when(plain, "hash").when(content, "content")
                     .when(only.isin(BEHAVIOURAL_FAMILIES), "behavioural")
                     .when(only.isin(CONTEXT_FAMILIES), "context").otherwise("hash"))
    direct = s.where(F.col("_kind") != "behavioural").withColumn(
        "split", F.when(F.col("_kind") == "hash", hashed)
        .when(F.col("_kind") == "content", F.coalesce(by_tool, F.lit("train")))
        .otherwise(F.coalesce(by_context, F.lit("train"))))
    ranked = rank_in_group(s.where(F.col("_kind") == "behavioural").withColumn("_family", only),
                           "_family", session)
    n_train, n_calib = F.bround(F.col("size") * 0.6), F.bround(F.col("size") * 0.2)
    placed = ranked.withColumn("split", F.when(F.col("rank") < n_train, "train")
                               .when(F.col("rank") < n_train + n_calib, "calib").otherwise("test"))
    return direct.select(session, "split").unionByName(placed.select(session, "split"))


#: More rows than any table has: no cap.
ALL_ROWS = 1 << 62


@dataclass(frozen=True)
class SliceSizes:
    """Row bounds of a benign split. Only what a model is fitted on is bounded by default; calibration and test take all
    rows. Defaults are otherwise the multi-domain protocol's."""
    train: int = 120_000
    calib: int = ALL_ROWS
    test: int = ALL_ROWS
    calib_share: float | None = 0.15
    calib_first: bool = True


# The single-domain protocol cuts train first, with a larger bound.
IN_DOMAIN_SIZES = SliceSizes(150_000, calib_share=None, calib_first=False)


def _calib_rows(sizes: SliceSizes, n: int) -> int:
    if sizes.calib_share is None:
        return sizes.calib
    return min(sizes.calib, max(1, int(n * sizes.calib_share)))


def _roles(keys: DataFrame, early: Column, sizes: SliceSizes) -> Column:
    """Role of a row from its shuffle place ``_place`` and whether it is early. The cut-offs are
    found on ``keys`` (places only) and enter the plan as numbers, so the rows themselves are read
    once and neither ranked nor joined."""
    calib, train = (lambda n: _calib_rows(sizes, n)), (lambda _: sizes.train)
    names = ("calib", "train") if sizes.calib_first else ("train", "calib")
    runs = (calib, train) if sizes.calib_first else (train, calib)
    a, b = slice_cuts(keys.where(early), "_place", *runs)
    place_ = F.col("_place")
    tested = F.lit(True)
    if sizes.test < ALL_ROWS:
        tested = place_ <= F.lit(order_values(keys.where(~early), "_place", lambda _: {"cut": sizes.test - 1})["cut"])
    return (F.when(early & (place_ <= a), names[0]).when(early & (place_ <= b), names[1])
            .when(~early & tested, "test"))


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("_place", place(X.signature(), H.SEED))


def with_time(df: DataFrame) -> DataFrame:
    """Parsed ``ts``; rows without a usable time are gone."""
    return df.withColumn("ts", clock.parse_iso("timestamp")).where(clock.is_usable(F.col("ts")))


def temporal_boundary(df: DataFrame, q: float = 0.70) -> float | None:
    """Linear quantile of ``ts`` in microseconds."""
    return quantile_linear(df, F.unix_micros("ts").cast("double"), q)


def temporal_split(df: DataFrame, q: float = 0.70, sizes: SliceSizes = SliceSizes(),
                   deduplicate: bool = True, boundary: float | None = None) -> DataFrame:
    """Early benign to ``train`` and ``calib``, later benign to ``test``; the boundary row is late."""
    rows = _placed(with_time(keep_first(df) if deduplicate else df))
    keys = settle(rows.select("ts", "_place"))
    boundary = temporal_boundary(keys, q) if boundary is None else boundary
    early = F.unix_micros("ts") < F.lit(boundary)
    role = _roles(keys, early, sizes)
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).drop("_place")


def hash_split(df: DataFrame, share: int = 70, sizes: SliceSizes = SliceSizes(),
               deduplicate: bool = True) -> DataFrame:
    """The control without time: 70 of 100 hash buckets are early."""
    rows = _placed(keep_first(df) if deduplicate else df).withColumn(
        "_early", H.bucket(X.signature(), 100) < share)
    keys = settle(rows.select("_early", "_place"))
    role = _roles(keys, F.col("_early"), sizes)
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).drop("_place", "_early")


def site_stratified_split(df: DataFrame, site: str = "site", q: float = 0.70, least: int = 10,
                          sizes: SliceSizes = SliceSizes()) -> DataFrame:
    """One time boundary per site, so every site is in train; tiny sites are early as a whole.
    ``df`` has ``ts`` already."""
    micros = F.unix_micros("ts").cast("double")
    bounds = group_quantile_linear(df, micros, q, [site], "_boundary")
    early = (F.col("n") < least) | (F.unix_micros("ts") < F.col("_boundary"))
    rows = _placed(df.join(bounds, site)).withColumn("_early", early).drop("_boundary", "n")
    keys = settle(rows.select("_early", "_place"))
    role = _roles(keys, F.col("_early"), sizes)
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).drop("_place", "_early")


def payload_split(attacks: DataFrame) -> DataFrame:
    """70/15/15 by family and payload, so no payload is in two slices."""
    h = H.unit(X.signature(["attack_family", "url_path_raw", "url_query", "request_body"]))
    return attacks.withColumn(
        "role", F.when(h < 0.70, "fit").when(h < 0.85, "calib").otherwise("test"))


def benign_split(df: DataFrame, train: float = 0.7) -> DataFrame:
    """Unique benign by signature hash into train and calib."""
    return keep_first(df).withColumn(
        "role", F.when(H.unit(X.signature()) < train, "train").otherwise("calib"))


def fit_and_calib(df: DataFrame, key: str | Column = "row_id", share: float = 0.2, least: int = 20) -> DataFrame:
    """A shuffled 80/20 cut: the first ``max(least, share n)`` rows calibrate."""
    placed = df.withColumn("_place", place(key, H.SEED))
    cut, _ = slice_cuts(placed, "_place", lambda n: max(least, int(n * share)), lambda _: 0)
    return placed.withColumn(
        "role", F.when(F.col("_place") <= cut, "calib").otherwise("fit")).drop("_place")


def tool_holdout(attacks: DataFrame, tools_a: Sequence[str], tool_b: str, least: int = 40,
                 tool: str = "attack_tool") -> DataFrame:
    """Both directions of a cross-tool holdout: ``direction`` and ``role`` (fit, calib, heldout).
    Empty when either side has fewer than ``least`` rows."""
    side = F.when(F.col(tool).isin(*tools_a), "A").when(F.col(tool) == tool_b, "B")
    sided = attacks.withColumn("_side", side).where(F.col("_side").isNotNull())
    support = sided.agg(F.count_if(F.col("_side") == "A").alias("a"), F.count_if(F.col("_side") == "B").alias("b")).first()
    if min(support.a, support.b) < least:
        sided = sided.where(F.lit(False))
    parts = []
    for train, held in (("A", "B"), ("B", "A")):
        fit = fit_and_calib(sided.where(F.col("_side") == train))
        test = sided.where(F.col("_side") == held).withColumn("role", F.lit("heldout"))
        parts.append(fit.unionByName(test).withColumn("direction", F.lit(f"{train}_to_{held}")))
    return parts[0].unionByName(parts[1]).drop("_side")


def attack_pools(attacks: DataFrame, holdout_source: DataFrame | None = None, holdout_tool: str = "custom",
                 train_cap: int | None = 60_000, test_cap: int | None = None) -> DataFrame:
    """Role of every attack: 70 % of the hashed payloads of the main source train, the rest
    test; a second source trains except for one tool, which is held out. Without a cap every payload has a role,
    and the main source is read once."""
    h = H.bucket(X.signature(), 10) < 7
    if train_cap is None and test_cap is None:
        pools = attacks.withColumn("role", F.when(h, "train").otherwise("test"))
    else:
        part = lambda rows, cap: rows if cap is None else seeded_sample(rows, cap, X.signature())
        pools = part(attacks.where(h), train_cap).withColumn("role", F.lit("train")).unionByName(
            part(attacks.where(~h), test_cap).withColumn("role", F.lit("test")))
    if holdout_source is None:
        return pools
    custom = F.coalesce(F.col("attack_tool") == holdout_tool, F.lit(False))
    other = holdout_source.withColumn("role", F.when(custom, "tool_test").otherwise("train"))
    return pools.unionByName(other, allowMissingColumns=True)


@dataclass(frozen=True)
class Fold:
    """Held-out benign source and held-out attack source (optionally one tool of it)."""
    benign: str
    attack: str
    tool: str | None = None

    @property
    def name(self) -> str:
        return f"{self.benign}/{self.attack}" + (f":{self.tool}" if self.tool else "")


@dataclass(frozen=True)
class FoldSizes:
    benign_per_source: int = 30_000
    attack_per_source: int = 30_000
    heldout_benign: int = ALL_ROWS
    heldout_attack: int = ALL_ROWS
    calib_share: float = 0.15


def _fold_pool(fold: Fold) -> Column:
    """What a row is in one fold before calibration is taken out; null when it is unused."""
    benign, source = F.col("label") == "benign", F.col("source_id")
    held = source.isin(fold.benign, fold.attack)
    pool = F.when(benign & (source == fold.benign), "heldout_benign")
    if fold.tool is None:
        pool = pool.when(~benign & (source == fold.attack), "heldout_attack")
    else:
        is_tool = F.coalesce(F.col("attack_tool") == fold.tool, F.lit(False))
        own = source == fold.attack
        pool = (pool.when(own & ~benign & is_tool, "heldout_attack")
                .when(own & ~benign, "attack").when(own & benign, "benign"))
    return pool.when(~held & benign, "benign").when(~held & ~benign, "attack")


def leave_one_source_out(df: DataFrame, folds: Sequence[Fold], sizes: FoldSizes = FoldSizes()) -> DataFrame:
    """Narrow table (fold, role, label, source_id, row_id, signature_key) of all folds at once.

    Training pools are bounded per source by hash cut-offs (held-out sets only on demand), calibration takes a
    hashed share of real benign and of attacks, and held-out rows whose request also occurs in
    training of that fold are dropped. Only keys move, never bodies."""
    if "attack_tool" not in df.columns:
        df = df.withColumn("attack_tool", F.lit(None).cast("string"))
    narrow = df.select("row_id", "source_id", "nature", "label", "attack_tool",
                       X.signature_key().alias("signature_key"))
    member = F.array_compact(F.array(*[
        F.when(_fold_pool(f).isNotNull(), F.struct(F.lit(f.name).alias("fold"), _fold_pool(f).alias("pool")))
        for f in folds]))
    rows = narrow.select("*", F.explode(member).alias("_m")).select(
        "row_id", "source_id", "nature", "label", "signature_key", "_m.fold", "_m.pool")
    rows = rows.withColumn("_place", H.shuffle_rank_key(
        F.concat_ws("|", "source_id", F.col("row_id").cast("string"))))
    cap = (F.when(F.col("pool") == "benign", sizes.benign_per_source)
           .when(F.col("pool") == "attack", sizes.attack_per_source)
           .when(F.col("pool") == "heldout_benign", sizes.heldout_benign).otherwise(sizes.heldout_attack))
    capped = smallest(settle(rows), "_place", cap, ["fold", "pool", "source_id"])
    share = H.unit(F.concat_ws("|", F.lit("calib"), F.col("source_id"), F.col("row_id").cast("string")))
    takes_part = (F.col("pool") == "attack") | ((F.col("pool") == "benign") & (F.col("nature") == "real"))
    role = (F.when(F.col("pool").startswith("heldout"), F.col("pool"))
            .when(takes_part & (share < sizes.calib_share), "calib").otherwise("fit"))
    placed = capped.withColumn("role", role).select(
        "fold", "role", "label", "source_id", "row_id", "signature_key")
    heldout = F.col("role").startswith("heldout")
    seen = placed.where(~heldout).select("fold", "signature_key").distinct()
    novel = placed.where(heldout).join(seen, ["fold", "signature_key"], "left_anti")
    return placed.where(~heldout).unionByName(novel)
