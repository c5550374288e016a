"""Balanced days: compass wedges from the depot, solved in parallel, evened out and trimmed to the shift."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..config import MILES_PER_M, PlannerConfig
from ..functions import geo
from ..operators.ranking import ranked
from .walk import Network, solve_day, trimmed

TURN = 2 * math.pi


def with_bearing(chains: DataFrame, depot: Column) -> DataFrame:
    """Add centroid and bearing from the depot to chains (coords)."""
    return chains.withColumn("centroid", geo.centroid(F.col("coords"))).withColumn("bearing", geo.bearing(depot, F.col("centroid")))


def circular_gaps(chains: DataFrame, angle: str = "bearing", tie: str = "chain_id") -> DataFrame:
    """Add ``rn`` (sweep order from 1) and ``gap`` to the next angle, the last one's to the first."""
    swept = checkpointed(ranked(chains.select(angle, tie), "rn", angle, tie).withColumn("rn", F.col("rn") + 1))
    n = swept.count()
    following = swept.select(F.when(F.col("rn") == 1, F.lit(n)).otherwise(F.col("rn") - 1).alias("rn"), F.col(angle).alias("_next"))
    gaps = swept.join(following, "rn").select(tie, "rn", F.pmod(F.col("_next") - F.col(angle), F.lit(TURN)).alias("gap"))
    return chains.join(gaps, tie).select(*chains.columns, "rn", "gap")


def seam_rotation(gapped: DataFrame) -> DataFrame:
    """Add ``turn``: the sweep order from 0, begun after the largest gap (the first of equals)."""
    whole = gapped.agg(F.max_by("rn", F.struct("gap", -F.col("rn"))).alias("_seam"), F.count("*").alias("_n"))
    return gapped.crossJoin(F.broadcast(whole)).withColumn("turn", F.pmod(F.col("rn") - 1 - F.col("_seam"), F.col("_n"))).drop("_seam", "_n")


def wedges(turned: DataFrame, days: int) -> DataFrame:
    """Add ``day`` (from 0): the bucket of the cumulative middle of time_s."""
    total = turned.agg(F.sum("time_s")).first()[0]
    at = F.try_divide(F.col("_before") + F.col("time_s") / 2, F.lit(total) / days)
    out = ranked(turned, "_at", "turn", _before="time_s").withColumn("day", F.least(F.coalesce(F.floor(at), F.lit(0)), F.lit(days - 1)).cast("int"))
    return out.drop("_at", "_before")


def fill_empty(groups: list[list[int]]) -> list[list[int]]:
    """An empty wedge takes the bordering chain of a neighbour that has more than one; those still empty go."""
    for day, own in enumerate(groups):
        if not own:
            for near, at in ((day - 1, -1), (day + 1, 0)):
                if 0 <= near < len(groups) and len(groups[near]) > 1:
                    own.append(groups[near].pop(at))
                    break
    return [g for g in groups if g]


def sweep_partition(chains: DataFrame, depot: tuple[float, float], days: int) -> list[list[int]]:
    """Groups of chain ids in sweep order; one row a chain comes to the driver, as all later steps decide on it."""
    swept = circular_gaps(with_bearing(chains, geo.point(F.lit(depot[0]), F.lit(depot[1]))))
    if days <= 1:
        return [[r["chain_id"] for r in swept.orderBy("rn").select("chain_id").collect()]]
    groups: list[list[int]] = [[] for _ in range(days)]
    for r in wedges(seam_rotation(swept), days).orderBy("turn").select("chain_id", "day").collect():
        groups[r["day"]].append(r["chain_id"])
    return fill_empty(groups)


def day_estimate(sections: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """One row (hours, days): collecting time of the sections' length_m, and the days to begin with, of which collecting takes a share."""
    hours = F.coalesce(F.sum("length_m"), F.lit(0.0)) * MILES_PER_M / config.collect_mph
    days = F.greatest(F.lit(1), F.least(F.lit(config.max_days), F.ceil(F.col("hours") / (config.shift_hours * config.collection_share))))
    return sections.agg(hours.alias("hours")).select("hours", days.cast("int").alias("days"))


def estimated_days(survey_m: float, days: int | None, config: PlannerConfig) -> tuple[int, int]:
    """(days to begin with, most days)."""
    most = days or config.max_days
    if days:
        return days, most
    hours = survey_m * MILES_PER_M / config.collect_mph
    return max(1, min(most, math.ceil(hours / (config.shift_hours * config.collection_share)))), most


def _parallel(spark: SparkSession, jobs: list[list[int]], net: Broadcast, max_hours: float | None = None) -> list[tuple[dict, list[int]]]:
    """Solve (and with ``max_hours`` trim) groups of chains, one task each."""
    if not jobs:
        return []

    def run(batches):
        for pdf in batches:
            out = []
            for members in pdf["members"]:
                day, left = solve_day(net.value, list(members)), []
                if max_hours is not None:
                    day, left = trimmed(net.value, day, max_hours)
                out.append(json.dumps([day, left], default=int))
            yield pd.DataFrame({"job": pdf["job"], "out": out})

    frame = spark.createDataFrame([(i, [int(c) for c in m]) for i, m in enumerate(jobs)], "job int, members array<long>")
    rows = frame.repartition(len(jobs), "job").mapInPandas(run, "job int, out string").collect()  # one short row a group
    return [tuple(json.loads(r["out"])) for r in sorted(rows)]


def solve_groups(spark: SparkSession, groups: list[list[int]], net: Broadcast) -> list[dict]:
    return [day for day, _ in _parallel(spark, groups, net)]


def moves(hours: list[float]) -> list[tuple[int, int, int]]:
    """(from, to, position): the heaviest day gives to lighter neighbours, the lightest takes from heavier ones."""
    hi, lo, out = hours.index(max(hours)), hours.index(min(hours)), []
    for src, dst in ((hi, hi - 1), (hi, hi + 1), (lo - 1, lo), (lo + 1, lo)):
        if 0 <= min(src, dst) and max(src, dst) < len(hours) and hours[dst] < hours[src]:
            out.append((src, dst, 0 if src > dst else -1))
    return out


def rebalance(spark: SparkSession, groups: list[list[int]], solved: list[dict], net: Broadcast) -> tuple[list[list[int]], list[dict]]:
    """Move bordering chains between neighbours while that narrows the spread of hours; each round solves all trials in one job."""
    config = net.value.config
    for _ in range(config.rebalance_rounds if len(solved) > 1 else 0):
        hours = [d["hours"] for d in solved]
        spread = max(hours) - min(hours)
        if spread <= config.rebalance_stop * sum(hours) / len(hours):
            break
        trials = []
        for src, dst, at in moves(hours):
            if len(groups[src]) > 1:
                moved = groups[src][at]
                trials.append((src, dst, [c for c in groups[src] if c != moved], [moved, *groups[dst]] if at == -1 else [*groups[dst], moved]))
        days = solve_groups(spark, [g for t in trials for g in t[2:]], net)
        best = None
        for i, (src, dst, *_) in enumerate(trials):
            now = list(hours)
            now[src], now[dst] = days[2 * i]["hours"], days[2 * i + 1]["hours"]
            width = max(now) - min(now)
            if width < spread and (best is None or width < best[0]):
                best = (width, i)
        if best is None:
            break
        i = best[1]
        src, dst, groups[trials[i][0]], groups[trials[i][1]] = trials[i]
        solved[src], solved[dst] = days[2 * i], days[2 * i + 1]
    return groups, solved


def plan_groups(spark: SparkSession, chains: DataFrame, depot: tuple[float, float], survey_m: float, net: Broadcast, days: int | None = None) -> tuple[list[dict], list[int]]:
    """(solved days, filler chains): sweep, solve, rebalance; add days while one is too long and more are allowed; trim."""
    config = net.value.config
    count, most = estimated_days(survey_m, days, config)
    while True:
        groups = sweep_partition(chains, depot, count)
        groups, solved = rebalance(spark, groups, solve_groups(spark, groups, net), net)
        if count >= most or max(d["hours"] for d in solved) <= config.shift_hours:
            break
        count += 1
    results = _parallel(spark, groups, net, config.shift_hours)
    solved, filler = [d for d, _ in results], [c for _, left in results for c in left]
    if filler:
        _, solved = rebalance(spark, [d["members"] for d in solved], solved, net)
    return solved, filler


def day_metrics(days: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """Add miles, efficiency and hours at the observed paces to rows with survey_m, deadhead_m and return_m."""
    survey, deadhead = F.col("survey_m") * MILES_PER_M, (F.col("deadhead_m") + F.col("return_m")) * MILES_PER_M
    efficiency = F.coalesce(F.try_divide(survey * 100, survey + deadhead), F.lit(0.0))
    return days.withColumns({"survey_mi": survey, "deadhead_mi": deadhead, "total_mi": survey + deadhead, "efficiency": efficiency, "hours": survey / config.collect_mph + deadhead / config.transfer_mph})


def day_table(spark: SparkSession, solved: list[dict], config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """One row a day: hours, miles, efficiency, jumps and one-way exceptions."""
    rows = [(i + 1, d["survey_m"], d["deadhead_m"], d["return_m"], d["return_s"], d["jumps"], d["wrong_way"], d["wrong_way_return"], len(d["members"])) for i, d in enumerate(solved)]
    return day_metrics(spark.createDataFrame(rows, "day int, survey_m double, deadhead_m double, return_m double, return_s double, jumps int, wrong_way int, wrong_way_return boolean, runs int"), config)


def day_balance(days: DataFrame) -> DataFrame:
    """min, max, average and spread of hours."""
    return days.agg(F.min("hours").alias("min_hours"), F.max("hours").alias("max_hours"), F.avg("hours").alias("avg_hours"), (F.max("hours") - F.min("hours")).alias("spread"), (F.try_divide((F.max("hours") - F.min("hours")) * 100, F.avg("hours"))).alias("spread_pct"))
