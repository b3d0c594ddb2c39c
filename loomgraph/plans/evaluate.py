"""Ranking metrics, paired comparison with bootstrap intervals, and gates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESAMPLES, GATE_K, MIN_COVERAGE = 2000, 10, 0.5


def per_case(runs: DataFrame, truth: DataFrame, k: int = GATE_K) -> DataFrame:
    """(variant, query, hits, relevant, first): what the first k ranks of each run find of each query's truth."""
    relevant = truth.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))
    variants = runs.select("variant").distinct()
    hit = runs.where(F.col("rank") <= k).join(truth, ["query", "doc"]).groupBy("variant", "query").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    cases = relevant.join(F.broadcast(variants))  # a handful of variants
    return cases.join(hit, ["variant", "query"], "left").select("variant", "query", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "relevant", "first")


def metrics(cases: DataFrame, k: int = GATE_K) -> DataFrame:
    """(variant, recall, precision, mean_recall, mrr, cases); null without a denominator, precision over k slots a case."""
    return cases.groupBy("variant").agg(
        F.try_divide(F.sum("hits"), F.sum("relevant")).alias("recall"),
        F.try_divide(F.sum("hits"), F.count(F.lit(1)) * k).alias("precision"),
        F.avg(F.try_divide(F.col("hits"), F.col("relevant"))).alias("mean_recall"),
        F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0))).alias("mrr"),
        F.count(F.lit(1)).alias("cases"),
    )


def outcomes(runs: DataFrame, truth: DataFrame, k: int = GATE_K, asked: DataFrame | None = None, live: DataFrame | None = None, latency: DataFrame | None = None) -> DataFrame:
    """``per_case`` with returned (answers among the first k ranks), stale (those whose document is not in ``live``) and micros.

    asked: query; all cases, those that nothing is relevant for too (without it, cases are the queries of the truth). live: doc. latency: variant, query, micros;
    the parts of a combination are summed. Without ``live`` or ``latency``, stale or micros is null.
    """
    cases = per_case(runs, truth, k)
    if asked is not None:
        every = asked.select("query").distinct().join(F.broadcast(runs.select("variant").distinct()))  # a handful of variants
        cases = every.join(cases, ["variant", "query"], "left").select("variant", "query", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hits", "relevant")), "first")
    shown = runs.where(F.col("rank") <= k)
    gone = F.lit(None).cast("long")
    if live is not None:
        shown = shown.join(live.select("doc", F.lit(True).alias("alive")).distinct(), "doc", "left")
        gone = F.count(F.when(F.col("alive").isNull(), 1))
    met = shown.groupBy("variant", "query").agg(F.count(F.lit(1)).alias("returned"), gone.alias("stale"))
    out = cases.join(met, ["variant", "query"], "left").withColumn("returned", F.coalesce("returned", F.lit(0)).cast("long"))
    if latency is None:
        return out.withColumn("micros", F.lit(None).cast("long"))
    return out.join(latency.groupBy("variant", "query").agg(F.sum("micros").cast("long").alias("micros")), ["variant", "query"], "left")


def readout(outcomes: DataFrame, k: int = GATE_K) -> DataFrame:
    """All metrics of each variant over ``outcomes``; null without a denominator.

    Pooled: recall, and precision over k slots a case. mean_recall is over cases_with_truth. coverage is the share of cases with an answer, found that of cases
    with a right one; stale_rate is of answers, latencies are in milliseconds.
    """
    whole = outcomes.groupBy("variant").agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum("hits").alias("hits"),
        F.sum("relevant").alias("relevant"),
        F.sum("returned").alias("returned"),
        F.sum("stale").alias("stale"),
        F.count(F.when(F.col("relevant") > 0, 1)).alias("cases_with_truth"),
        F.avg(F.try_divide(F.col("hits"), F.col("relevant"))).alias("mean_recall"),
        F.count(F.when(F.col("returned") > 0, 1)).alias("cases_answered"),
        F.count("first").alias("cases_found"),
        (F.avg("micros") / 1000).alias("mean_latency_ms"),
        (F.max("micros") / 1000).alias("max_latency_ms"),
    )
    return whole.select(
        "variant", "cases", "hits", "relevant", "returned",
        F.try_divide("hits", "relevant").alias("recall"), F.try_divide(F.col("hits"), F.col("cases") * k).alias("precision"),
        "cases_with_truth", "mean_recall", "cases_answered", F.try_divide("cases_answered", "cases").alias("coverage"), F.try_divide("cases_found", "cases").alias("found"),
        F.try_divide("stale", "returned").alias("stale_rate"), "mean_latency_ms", "max_latency_ms",
    )


def splitmix(n: int, seed: int) -> np.ndarray:
    """n 64-bit values of the splitmix sequence."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def bootstrap_interval(values: np.ndarray, resamples: int = RESAMPLES, seed: int = 20260907) -> tuple[float, float] | None:
    """2.5 and 97.5 percentiles of the resampled mean; None under two values."""
    n = len(values)
    if n < 2:
        return None
    means = np.empty(resamples)
    block = max(1, 2_000_000 // n)
    for a in range(0, resamples, block):
        b = min(resamples, a + block)
        draws = splitmix((b - a) * n, seed + a * n) % np.uint64(n)
        means[a:b] = values[draws.astype(np.int64)].reshape(b - a, n).mean(axis=1)
    means.sort()
    return float(means[int(np.ceil(0.025 * resamples)) - 1]), float(means[int(np.ceil(0.975 * resamples)) - 1])


def difference(d: np.ndarray) -> dict:
    """n, mean_difference, low, high and verdict of the cases' differences."""
    found = bootstrap_interval(d)
    low, high = found or (None, None)
    verdict = "unevaluable" if found is None else "above" if low > 0 else "below" if high < 0 else "undecided"
    return {"n": len(d), "mean_difference": d.mean() if len(d) else None, "low": low, "high": high, "verdict": verdict}


def paired(cases: DataFrame, left: str, right: str) -> DataFrame:
    """(metric, n, mean_difference, low, high, verdict) of the cases' recall, left minus right."""
    recall = F.try_divide(F.col("hits"), F.col("relevant"))
    a = cases.where(F.col("variant") == left).select("query", recall.alias("a"))
    b = cases.where(F.col("variant") == right).select("query", recall.alias("b"))

    def interval(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"metric": "recall", **difference(part.sort_values("query")["d"].to_numpy(float))}])

    # one number per evaluated case
    joined = a.join(b, "query").select("query", (F.col("a") - F.col("b")).alias("d"), F.lit(0).alias("all"))
    return joined.groupBy("all").applyInPandas(interval, "metric string, n long, mean_difference double, low double, high double, verdict string")


def folds(cases: DataFrame, n: int = 5, *within: str) -> DataFrame:
    """Rolling-origin folds: cases by (cutoff, id) in n consecutive parts of like size, of each group if ``within`` names one. Evaluation cases are few; one task orders a group."""
    from pyspark.sql import Window

    order = Window.partitionBy(*within or [F.lit(0)]).orderBy("cutoff", "case_id")
    return cases.withColumn("fold", (F.ntile(n).over(order) - 1).cast("long"))


def grid(axes: dict[str, list], cap: int = 256) -> list[dict]:
    """Distinct cells of the options' product, in order; more than ``cap`` is an error."""
    import itertools

    cells = list(dict.fromkeys(itertools.product(*axes.values())))
    if len(cells) > cap:
        raise ValueError(f"{len(cells)} cells; at most {cap}")
    return [dict(zip(axes, c, strict=True)) for c in cells]


def sweep(cases: DataFrame) -> DataFrame:
    """(cell, mean_recall, mean_symbol_recall) of the best cell: by mean recall over the selection fold's cases, then by symbols, then the first cell.

    cases: cell, hits, relevant, symbol_hits, symbol_relevant.
    """
    means = cases.groupBy("cell").agg(
        F.coalesce(F.avg(F.try_divide(F.col("hits"), F.col("relevant"))), F.lit(0.0)).alias("mean_recall"),
        F.coalesce(F.avg(F.try_divide(F.col("symbol_hits"), F.col("symbol_relevant"))), F.lit(0.0)).alias("mean_symbol_recall"),
    )
    return means.orderBy(F.desc("mean_recall"), F.desc("mean_symbol_recall"), "cell").limit(1)


def corpus(cases: DataFrame, runs: DataFrame, truth: DataFrame, n: int = 5, k: int = GATE_K) -> DataFrame:
    """(fold, variant, cases, recall, mean_recall, mrr) of the valid cases (case_id, cutoff, text): those with a text and something relevant, in rolling-origin folds.

    runs: variant, query, doc, rank; truth: query, doc. ``query`` is the case's id.
    """
    valid = cases.where("length(trim(text)) > 0").join(truth.select(F.col("query").alias("case_id")).distinct(), "case_id", "left_semi")
    placed = folds(valid, n).select(F.col("case_id").alias("query"), "fold")
    found = per_case(runs, truth, k).join(placed, "query")
    return found.groupBy("fold", "variant").agg(
        F.count(F.lit(1)).alias("cases"),
        F.try_divide(F.sum("hits"), F.sum("relevant")).alias("recall"),
        F.avg(F.try_divide(F.col("hits"), F.col("relevant"))).alias("mean_recall"),
        F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0))).alias("mrr"),
    )


def live_holdout(deliveries: DataFrame, held: int, k: int = GATE_K) -> DataFrame:
    """(variant, cohort, cases, recall, mrr) of predicting the newest ``held`` deliveries' files from the deliveries of earlier days alone.

    Variants rank all known files by how many deliveries changed them (frequency) or by the newest that did (recency), ties by name. Cohorts are
    all held deliveries and the verified ones. A held delivery among those that are learnt from is an error.
    """
    from pyspark.sql import Window

    newest = deliveries.select("delivery_id", "day", "distance", "verified").distinct().orderBy("distance", F.desc("delivery_id")).limit(held)  # ``held`` rows
    first = newest.agg(F.min("day").alias("first_day"))  # one row
    known = deliveries.join(F.broadcast(first), F.col("day") < F.col("first_day")).drop("first_day")
    if known.join(F.broadcast(newest.select("delivery_id")), "delivery_id", "left_semi").limit(1).count():
        raise ValueError("a held delivery is among those that are learnt from")
    stats = known.groupBy("file").agg(F.countDistinct("delivery_id").alias("n"), F.min("distance").alias("last"))
    ranked = stats.select(F.lit("frequency").alias("variant"), "file", (-F.col("n")).alias("key")).unionByName(stats.select(F.lit("recency").alias("variant"), "file", F.col("last").alias("key")))
    # the first k files of each variant, by partial top-k
    tops = None
    for name in ("frequency", "recency"):
        top = ranked.where(F.col("variant") == name).orderBy("key", "file").limit(k).withColumn("rank", F.row_number().over(Window.partitionBy("variant").orderBy("key", "file")))
        tops = top if tops is None else tops.unionByName(top)
    truth = deliveries.join(F.broadcast(newest.select("delivery_id")), "delivery_id", "left_semi").select("delivery_id", "verified", "file").distinct()
    relevant = truth.groupBy("delivery_id", "verified").agg(F.count(F.lit(1)).alias("relevant"))
    hits = truth.join(F.broadcast(tops.select("variant", "file", "rank")), "file").groupBy("delivery_id", "variant").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    names = F.explode(F.array(F.lit("frequency"), F.lit("recency"))).alias("variant")
    cases = relevant.select("*", names).join(hits, ["delivery_id", "variant"], "left")
    cohorts = F.explode(F.when(F.col("verified"), F.array(F.lit("all"), F.lit("verified"))).otherwise(F.array(F.lit("all")))).alias("cohort")
    return cases.select("*", cohorts).groupBy("variant", "cohort").agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"),
        F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0))).alias("mrr"),
    )


def gate(comparisons: dict[str, str], coverage: float, needed: tuple[str, ...]) -> str:
    """pass if every needed comparison lies above 0 and coverage suffices; unevaluable if one is missing."""
    if any(comparisons.get(name, "unevaluable") == "unevaluable" for name in needed):
        return "unevaluable"
    return "pass" if coverage >= MIN_COVERAGE and all(comparisons[name] == "above" for name in needed) else "fail"


#: What a comparison that no two cases have says.
NOTHING = {"n": 0, "mean_difference": None, "low": None, "high": None, "verdict": "unevaluable"}


def comparisons(cases: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], dict]:
    """What ``paired`` says of each pair of variants, over the cases that something is relevant for; one job for all pairs."""
    recall = cases.select("variant", "query", F.try_divide(F.col("hits"), F.col("relevant")).alias("recall")).where("recall is not null")
    asked = cases.sparkSession.createDataFrame(sorted(set(pairs)), "left string, right string")  # a handful of pairs

    def interval(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"left": part["left"].iloc[0], "right": part["right"].iloc[0], **difference(part.sort_values("query")["d"].to_numpy(float))}])

    a = recall.select(F.col("variant").alias("left"), "query", F.col("recall").alias("a")).join(F.broadcast(asked), "left")
    b = recall.select(F.col("variant").alias("right"), "query", F.col("recall").alias("b"))
    joined = a.join(b, ["right", "query"]).select("left", "right", "query", (F.col("a") - F.col("b")).alias("d"))
    found = joined.groupBy("left", "right").applyInPandas(interval, "left string, right string, n long, mean_difference double, low double, high double, verdict string")
    rows = {(r["left"], r["right"]): {c: r[c] for c in NOTHING} for r in found.collect()}
    return {pair: rows.get(pair, NOTHING) for pair in pairs}


@dataclass(frozen=True)
class Roles:
    """Which variant the gates decide on (subject), what it must beat (floor; G1), the rankings that exist already (existing; G2), combinations of it with
    others, and what may stand in for it (alternatives)."""

    subject: str = "word_index"
    floor: tuple[str, ...] = ("frequency", "bm25_code")
    existing: tuple[str, ...] = ("combined", "task_search_only")
    combinations: tuple[str, ...] = ("word_index_plus_mentions", "word_index_bm25_rrf")
    alternatives: tuple[str, ...] = ("bm25_code", "word_index_plus_mentions", "word_index_bm25_rrf")


@dataclass(frozen=True)
class Setting:
    """An option for G4: its baseline and the selected setting, and the cells (variants of the cells' cases) that have them, or why there are none."""

    name: str
    baseline: str
    selected: str | None = None
    cells: tuple[str, str] | None = None  # selected, baseline
    unavailable: str | None = None


def described(left: str, right: str, row: dict) -> str:
    says = f"no interval ({row['n']} cases)" if row["low"] is None else f"{row['mean_difference']:+.3f} [{row['low']:+.3f}, {row['high']:+.3f}] over {row['n']} cases"
    return f"{left} - {right}: {says}"


def outcome(name: str, state: str = "unevaluable", reason: str = "", **more) -> dict:
    """One gate's row."""
    return {"gate": name, "state": state, "reason": reason, "coverage": None, "keep": None, "alternative": None, "combinations": [], "option": None, "selected": None, "kept": None, **more}


def gate_one(found: dict, coverage: float | None, recalls: dict[str, float | None], roles: Roles) -> dict:
    """The subject beats its floor at enough coverage; else the alternative of the greatest mean recall, the first of equals."""
    against = {v: found[roles.subject, v] for v in roles.floor}
    numbers = "; ".join(described(roles.subject, v, row) for v, row in against.items()) + f"; coverage {'n/a' if coverage is None else format(coverage, '.3f')}"
    state = gate({v: row["verdict"] for v, row in against.items()}, coverage or 0.0, roles.floor)
    if coverage is None or not roles.floor or state == "unevaluable":
        return outcome("G1", reason=f"fewer than two cases with truth to pair; {numbers}", coverage=coverage)
    value = lambda v: float("-inf") if recalls.get(v) is None else recalls[v]
    other = max(roles.alternatives, key=value, default=None) if state == "fail" else None
    return outcome("G1", state, numbers, coverage=coverage, alternative=other)


def gate_two(found: dict, roles: Roles) -> dict:
    """The subject beats every existing ranking; else the one that beats it by most is kept. Combinations that beat both parts are named."""
    against = {v: found[roles.subject, v] for v in roles.existing}
    numbers = "; ".join(described(roles.subject, v, row) for v, row in against.items())
    if not against or any(row["verdict"] == "unevaluable" for row in against.values()):
        return outcome("G2", reason=f"fewer than two cases with truth to pair; {numbers}")
    both = [c for c in roles.combinations if all(found[c, v]["verdict"] == "above" for v in (roles.subject, *roles.existing))]
    if all(row["verdict"] == "above" for row in against.values()):
        return outcome("G2", "pass", numbers, keep=roles.subject, combinations=both)
    winners = [v for v, row in against.items() if row["verdict"] == "below"]
    return outcome("G2", "fail", numbers, keep=min(winners, key=lambda v: against[v]["mean_difference"], default=None), combinations=both)


def gate_four(setting: Setting, file: dict, symbol: dict) -> dict:
    """The selected setting is kept if it is better at one level and not worse at the other; a setting at its baseline is none to keep."""
    named = {"option": setting.name, "selected": setting.selected, "kept": setting.baseline}
    if setting.unavailable is not None:
        return outcome("G4", reason=setting.unavailable, **named)
    if setting.cells is None:
        return outcome("G4", "fail", f"{setting.name} is at its baseline", **named)
    a, b = file["verdict"], symbol["verdict"]
    numbers = "file " + described(*setting.cells, file) + "; symbol " + described(*setting.cells, symbol)
    if "unevaluable" in (a, b):
        return outcome("G4", reason=f"fewer than two cases with truth to pair at both levels; {numbers}", **named)
    if (a == "above" and b != "below") or (b == "above" and a != "below"):
        return outcome("G4", "pass", numbers, **{**named, "kept": setting.selected})
    return outcome("G4", "fail", numbers, **named)


def gates(
    cases: DataFrame, roles: Roles = Roles(), k: int = GATE_K, coverage: float | None = None, settings: tuple[Setting, ...] = (),
    cell_files: DataFrame | None = None, cell_symbols: DataFrame | None = None, unavailable: str | None = None,
) -> list[dict]:
    """G1, G2, and G4 for each of ``settings``, of ``outcomes``; G3 is not reported.

    coverage: that of the subject's readout unless it is given. cell_files, cell_symbols: the cells' cases at both levels, needed by settings with cells.
    unavailable: why there are no cases for G1 and G2. The gates are defined on k = 10; for others all are unevaluable.
    """
    blocked = f"the gates are defined on recall@{GATE_K}; this corpus scores k = {k}" if k != GATE_K else None
    if unavailable or blocked:
        out = [outcome(name, reason=unavailable or blocked) for name in ("G1", "G2")]
    else:
        others = (roles.subject, *roles.existing)
        pairs = [(roles.subject, v) for v in roles.floor + roles.existing] + [(c, v) for c in roles.combinations for v in others]
        found = comparisons(cases, pairs)
        rows = {r["variant"]: r for r in readout(cases, k).collect()}  # a handful of variants
        if coverage is None and roles.subject in rows:
            coverage = rows[roles.subject]["coverage"]
        out = [gate_one(found, coverage, {v: r["mean_recall"] for v, r in rows.items()}, roles), gate_two(found, roles)]
    told = [s if s.unavailable or not blocked else Setting(s.name, s.baseline, s.selected, unavailable=blocked) for s in settings]
    pairs = [s.cells for s in told if s.cells and not s.unavailable]
    files, symbols = (comparisons(level, pairs) if pairs else {} for level in (cell_files, cell_symbols))
    return out + [gate_four(s, files.get(s.cells, NOTHING), symbols.get(s.cells, NOTHING)) for s in told]
