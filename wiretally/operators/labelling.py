"""Labels from campaigns: by source address and time window, never by content.

A flow takes the first campaign, in file-name order, of its own source whose closed window holds it. Campaigns of a source may overlap,
so they are first swept into elementary windows, which don't: each holds the one campaign that wins in it. Then every flow needs the
last window that starts not after it, and that is an as-of match by a sorted merge.

Both steps run inside (source, slot, piece). A slot is a stretch of ``seconds``; a slot of one source with more than ``piece_rows`` flows
and campaign starts is cut into 2, 4, 8, ... pieces of time, as its own count asks. A campaign goes only to the slots and pieces in
which it begins or ends; of those that cover a slot or piece from end to end the first wins, and an aggregation finds it."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wiretally.functions import clock, identity
from wiretally.schema import UNIFIED_FIELDS
from wiretally.session import tabled

SLOT_SECONDS = 86_400
PIECE_ROWS = 1_000_000
_KEYS = ["src_ip", "_slot", "_piece"]


def _plan(flows: DataFrame, campaigns: DataFrame, span: int, piece_rows: int) -> DataFrame:
    """(src_ip, _slot, pieces) for the slots of a source that hold too many rows for one task: at most one in ``piece_rows`` rows."""
    at = flows.select("src_ip", F.expr(f"floor(_at / {span}D)").cast("long").alias("_slot"))
    starts = campaigns.select("src_ip", F.expr(f"floor(_start / {span}D)").cast("long").alias("_slot"))
    counted = at.unionByName(starts).groupBy("src_ip", "_slot").agg(F.count("*").alias("_n")).where(F.col("_n") > piece_rows)
    pieces = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n") / piece_rows))).cast("long")
    return tabled(counted.select("src_ip", "_slot", F.least(pieces, F.lit(1 << 20)).alias("pieces")), "pieces")


def _pieced(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(plan, ["src_ip", "_slot"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))


def _first_of_whole(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of campaigns that cover a slot or piece from end to end only the first one counts there; combined before the shuffle."""
    return rows.groupBy(*by).agg(F.min("_campaign").alias("_campaign"))


def _parts(campaigns: DataFrame, plan: DataFrame, span: int) -> DataFrame:
    """Campaigns cut at the bounds of slots and pieces: (src_ip, _slot, _piece, _from, _to, _campaign)."""
    slot = lambda c: F.expr(f"floor({c} / {span}D)").cast("long")
    c = campaigns.withColumns({"_a": slot("_start"), "_b": slot("_end")})
    ends = c.withColumn("_slot", F.explode(F.array_distinct(F.array("_a", "_b")))).select(
        "src_ip", "_slot", F.greatest("_start", F.col("_slot") * span).alias("_from"),
        F.least("_end", (F.col("_slot") + 1) * span - 1).alias("_to"), "_campaign")
    between = c.where("_b - _a > 1").select("src_ip", F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)).alias("_slot"), "_campaign")
    whole = _first_of_whole(between, ["src_ip", "_slot"]).select(
        "src_ip", "_slot", (F.col("_slot") * span).alias("_from"), ((F.col("_slot") + 1) * span - 1).alias("_to"), "_campaign")
    cut = _pieced(ends.unionByName(whole), plan).withColumns(
        {"_a": _piece(F.col("_from"), span), "_b": _piece(F.col("_to"), span)})
    # The first place of a piece is the least one that _piece() puts into it.
    first = lambda p: F.col("_slot") * span + F.ceil((p * span) / F.col("pieces")).cast("long")
    edges = cut.withColumn("_piece", F.explode(F.array_distinct(F.array("_a", "_b"))))
    inner = cut.where("_b - _a > 1").select("src_ip", "_slot", "pieces", F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)).alias("_piece"), "_campaign")
    full = _first_of_whole(inner, ["src_ip", "_slot", "pieces", "_piece"])
    begin, stop = first(F.col("_piece")), first(F.col("_piece") + 1) - 1
    return edges.select(*_KEYS, F.greatest("_from", begin).alias("_from"), F.least("_to", stop).alias("_to"), "_campaign").unionByName(
        full.select(*_KEYS, begin.alias("_from"), stop.alias("_to"), "_campaign"))


def _piece(at: Column, span: int) -> Column:
    return F.floor((at - F.col("_slot") * span) * F.col("pieces") / F.lit(float(span))).cast("long")


def sweep(spans: list[tuple]) -> list[tuple]:
    """Disjoint windows (start, end, winner) from spans (start, end, rank, winner) sorted by start: at each time the least rank
    of those open wins. All bounds are closed."""
    out, open_, now = [], [], None

    def until(limit: int | None) -> None:
        nonlocal now
        while open_ and (limit is None or now < limit):
            rank, end, winner = open_[0]
            if end < now:
                heapq.heappop(open_)
                continue
            stop = end if limit is None else min(end, limit - 1)
            if out and out[-1][2] is winner and out[-1][1] == now - 1:
                out[-1] = (out[-1][0], stop, winner)
            else:
                out.append((now, stop, winner))
            now = stop + 1

    for k, (start, end, rank, winner) in enumerate(spans):
        until(start)
        now = start
        heapq.heappush(open_, ((rank, k), end, winner))
    until(None)
    return out


def elementary_windows(parts: DataFrame) -> DataFrame:
    """(src_ip, _slot, _piece, _from, _to, _campaign): within each piece disjoint windows, each with its winning campaign. A task holds
    the campaigns of one piece at a time."""
    wanted = parts.select(*_KEYS, "_from", "_to", "_campaign")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def windows(schema: pa.Schema) -> pa.RecordBatch:
            found = sweep(held)
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, a, b, c), strict=True)) for a, b, c in found], schema)

        for batch in batches:
            for *of, start, end, campaign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != key:
                    if held:
                        yield windows(batch.schema)
                    key, held = of, []
                held.append((start, end, tuple(campaign[c] for c in ("ord", "start", "end", "campaign_id")), campaign))
            schema = batch.schema
        if held:
            yield windows(schema)

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartition(n, *_KEYS).sortWithinPartitions(*_KEYS, "_from", "_campaign.ord").mapInArrow(run, wanted.schema)


def match_campaigns(flows: DataFrame, campaigns: DataFrame, seconds: int = SLOT_SECONDS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Every flow with its first matching campaign as the struct ``match`` (null if none, or if the flow has no time or source).

    The window is closed on both ends; campaigns that end before they start are left out. Flows are dealt out by (source, slot, piece) once
    and merged with the windows there; none is copied. Rows with equal times are as good as any."""
    span = seconds * 1_000_000
    start, end = F.unix_micros(clock.parse_iso("start_ts")), F.unix_micros(clock.parse_iso("end_ts"))
    timed = campaigns.withColumns({"_start": start, "_end": end}).where("_start <= _end AND src_ip IS NOT NULL").select(
        "src_ip", "_start", "_end", F.struct(
            F.col("ord"), F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("campaign_id"), F.col("start_ts"), F.col("end_ts"),
            F.col("app").alias("campaign_app"), F.col("label"), F.col("attack_family"), F.col("attack_tool")).alias("_campaign"))
    timed = tabled(timed, "campaigns")
    placed = flows.withColumn("_at", F.unix_micros(clock.parse_iso("timestamp")))
    usable = placed.where("_at IS NOT NULL AND src_ip IS NOT NULL")
    plan = _plan(usable, timed, span, piece_rows)
    windows = elementary_windows(_parts(timed, plan, span))
    merged = _pieced(usable.withColumn("_slot", F.expr(f"floor(_at / {span}D)").cast("long")), plan)
    merged = merged.withColumns({"_piece": _piece(F.col("_at"), span), "_kind": F.lit(1)}).unionByName(
        windows.select(*_KEYS, F.col("_from").alias("_at"), F.struct("_to", "_campaign").alias("_window"), F.lit(0).alias("_kind")),
        allowMissingColumns=True)
    before = W.partitionBy(*_KEYS).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = merged.withColumn("_last", F.last("_window", ignorenulls=True).over(before)).where("_kind = 1")
    matched = last.withColumn("match", F.when(F.col("_at") <= F.col("_last._to"), F.col("_last._campaign")))
    rest = placed.where("_at IS NULL OR src_ip IS NULL").withColumn("match", F.lit(None).cast(matched.schema["match"].dataType))
    return matched.select(*flows.columns, "match").unionByName(rest.select(*flows.columns, "match"))


def label_flows(flows: DataFrame, campaigns: DataFrame, seconds: int = SLOT_SECONDS) -> DataFrame:
    """Attributable flows with session and provenance columns filled in."""
    matched = match_campaigns(flows, campaigns, seconds).where(F.col("match").isNotNull())
    m = F.col("match")
    app = F.coalesce(F.col("app") if "app" in flows.columns else F.lit(None), m["campaign_app"])
    labelled = matched.withColumns({
        "app": app,
        "label": m["label"], "attack_family": m["attack_family"], "attack_tool": m["attack_tool"],
        "campaign_id": m["campaign_id"],
        "label_source": identity.provenance(m["campaign_id"], m["attack_tool"], F.col("src_ip"),
                                            m["start_ts"], m["end_ts"]),
    })
    return identity.with_session_id(labelled).drop("match")


def unmatched_flows(flows: DataFrame, campaigns: DataFrame, seconds: int = SLOT_SECONDS) -> DataFrame:
    """Flows no campaign accounts for: fail on any, or drop them, as the caller decides."""
    return match_campaigns(flows, campaigns, seconds).where(F.col("match").isNull()).drop("match")


def require_attributable(flows: DataFrame, campaigns: DataFrame) -> None:
    missing = unmatched_flows(flows, campaigns).count()
    if missing:
        raise ValueError(f"{missing} flows matched no campaign window")


def rows_in_attack_windows(benign: DataFrame, campaigns: DataFrame,
                           seconds: int = SLOT_SECONDS) -> DataFrame:
    """Benign rows inside some attack window of their own source."""
    attacks = campaigns.where(F.col("label") == "attack")
    matched = match_campaigns(benign.drop("label"), attacks, seconds)
    return matched.where(F.col("match").isNotNull()).drop("match")


def unified(labelled: DataFrame) -> DataFrame:
    return labelled.select(*[c for c in UNIFIED_FIELDS if c in labelled.columns])
