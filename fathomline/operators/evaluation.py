"""Evaluation of labelled cases: proportions, bounds, pull-request metrics, risk curves, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Z_ONE, ratio, wilson

C = F.col


def _actionable(label: Column) -> Column:
    return label.isin("coordinate", "already_coordinated", "accepted_risk")


def _selected() -> Column:
    return C("policy_selected") & (C("detector_output") == "candidate") & ~C("suppressed")


#: For each metric, which cases count, which succeed, and which are indeterminate (A10). Cases without labels
#: count as failures where a selection alone admits them.
def metric_rules() -> dict[str, tuple[Column, Column, Column]]:
    edge, impact, action = C("label_edge"), C("label_impact"), C("label_action")
    detected = C("detector_output").isin("candidate", "abstained")
    no = F.lit(False)
    true = lambda c: F.coalesce(c, no)
    return {
        "edge_precision": (_selected(), true(edge == "confirmed"), true(edge == "indeterminate")),
        "impact_precision": (_selected(), true(impact == C("claim_impact")), true(impact == "indeterminate") | (C("claim_impact") == "unknown")),
        "actionable_precision": (_selected() & (C("claim_action") == "coordinate"), true(_actionable(action)), true(action == "indeterminate")),
        "consumer_edge_recall": (true(edge.isin("confirmed", "indeterminate")), detected, true(edge == "indeterminate")),
        "known_break_recall": (true(impact.isin("breaking", "indeterminate")), detected, true(impact == "indeterminate")),
        "false_omission": (C("detector_output").isin("no_candidate", "not_analysed"), true(~_actionable(action)), true(action == "indeterminate")),
    }


def proportion(counts: Column, success: Column, open_: Column, weight: Column, name: str) -> list[Column]:
    """Aggregates of one proportion: total and successes without indeterminate cases, their number, and the
    weighted estimate (A7)."""
    full = counts & ~open_
    return [
        F.count_if(full).alias(f"{name}_total"),
        F.count_if(full & success).alias(f"{name}_successes"),
        F.count_if(counts & open_).alias(f"{name}_indeterminate"),
        ratio(F.sum(F.when(full & success, weight)), F.sum(F.when(full, weight))).alias(f"{name}_weighted"),
    ]


def metric_set(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All six proportions in one aggregation, long form with Wilson's bounds."""
    rules = metric_rules()
    wide = cases.groupBy(*(by or [])).agg(*(c for n, r in rules.items() for c in proportion(*r, C("weight"), n)))
    names = ", ".join(f"'{n}', {n}_total, {n}_successes, {n}_indeterminate, {n}_weighted" for n in rules)
    long = wide.select(*(by or []), F.expr(f"stack({len(rules)}, {names}) AS (metric, total, successes, indeterminate, weighted)"))
    return _bounded(long)


def _bounded(long: DataFrame) -> DataFrame:
    low, high = wilson(C("successes"), C("total"), Z_ONE)
    everything = C("total") + C("indeterminate")
    return long.withColumns({
        "lower95": F.round(low, 9),
        "worst_case": F.round(ratio(C("successes"), everything), 9),
        "best_case": F.round(ratio(C("successes") + C("indeterminate"), everything), 9),
        "weighted": F.round(F.coalesce("weighted", F.lit(0.0)), 9),
    })


def grouped_metrics(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Metric sets by each key alone, all in one pass over the cases through grouping sets."""
    rules = metric_rules()
    narrow = cases.select(*(C(k).cast("string").alias(k) for k in keys), "weight", *(c.alias(f"{n}_{i}") for n, r in rules.items() for i, c in enumerate(r)))
    aggregates = [c for n in rules for c in proportion(C(f"{n}_0"), C(f"{n}_1"), C(f"{n}_2"), C("weight"), n)]
    wide = narrow.groupingSets([[C(k)] for k in keys], *map(C, keys)).agg(F.grouping_id().alias("_g"), *aggregates)
    name = F.coalesce(*(F.when(C("_g") == sum(1 << (len(keys) - 1 - j) for j in range(len(keys)) if j != i), F.lit(k)) for i, k in enumerate(keys)))
    stacked = ", ".join(f"'{n}', {n}_total, {n}_successes, {n}_indeterminate, {n}_weighted" for n in rules)
    long = wide.select(name.alias("grouping"), F.coalesce(*map(C, keys)).alias("value"), F.expr(f"stack({len(rules)}, {stacked}) AS (metric, total, successes, indeterminate, weighted)"))
    return _bounded(long)


def pull_request_metrics(cases: DataFrame) -> DataFrame:
    """One row over two levels: pull requests, then the population (A11). A pull request weighs as its heaviest
    case; its alert is right if any of its cases is actionable, open if all are indeterminate."""
    key = ["organization", "pull_request"]
    action, weight = C("label_action"), C("weight")
    when = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    prs = cases.groupBy(*key).agg(
        F.max("weight").alias("weight"),
        F.bool_or(_selected()).alias("alerted"),
        F.bool_or(F.coalesce(_actionable(action), F.lit(False))).alias("success"),
        F.bool_and(F.coalesce(action == "indeterminate", F.lit(False))).alias("open"),
        F.bool_or(C("detector_output") != "not_analysed").alias("analysed"),
        when(_selected()).alias("selected_weight"),
        when(C("detector_output").isin("candidate", "abstained")).alias("candidate_weight"),
        when(action.isNotNull()).alias("labelled_weight"),
        F.sum("weight").alias("case_weight"),
        F.sum(C("cost_microunits") * weight).alias("cost"),
        F.count("*").alias("cases"),
        F.count_if("independently_labelled").alias("independent"),
        F.count_if(C("analysis_outcome") == "superseded").alias("superseded"),
        F.count_if(C("analysis_outcome") == "timeout").alias("timed_out"),
    )
    alerted, population = F.sum(F.when(C("alerted"), weight)), F.sum("weight")
    out = prs.agg(
        F.coalesce(F.sum("cases"), F.lit(0)).alias("sampled_cases"),
        F.coalesce(F.sum("independent"), F.lit(0)).alias("independently_labelled"),
        F.count("*").alias("pull_requests"),
        *proportion(C("alerted"), C("success"), C("open"), weight, "alert"),
        F.round(ratio(F.sum(F.when(C("analysed"), weight)), population), 9).alias("analysis_coverage"),
        F.round(ratio(F.sum("selected_weight"), F.sum("candidate_weight")), 9).alias("selection_coverage"),
        F.round(ratio(F.sum("labelled_weight"), F.sum("case_weight")), 9).alias("label_coverage"),
        F.round(ratio(F.sum("selected_weight") * 1000, population), 9).alias("findings_per_thousand"),
        F.round(ratio(alerted * 1000, population), 9).alias("alerted_per_thousand"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.round(ratio(F.sum("cost"), population), 9).alias("mean_cost"),
        F.coalesce(F.sum("superseded"), F.lit(0)).alias("superseded"),
        F.coalesce(F.sum("timed_out"), F.lit(0)).alias("timed_out"),
    )
    low, _ = wilson(C("alert_successes"), C("alert_total"))
    everything = C("alert_total") + C("alert_indeterminate")
    return out.withColumns({
        "alert_weighted": F.round(F.coalesce("alert_weighted", F.lit(0.0)), 9),
        "alert_lower95": F.round(low, 9),
        "alert_worst_case": F.round(ratio(C("alert_successes"), everything), 9),
        "alert_best_case": F.round(ratio(C("alert_successes") + C("alert_indeterminate"), everything), 9),
    })


def _discrete(p: float, value: str) -> Column:
    return F.expr(f"coalesce(percentile_disc({p}) WITHIN GROUP (ORDER BY {value}), 0)").cast("long")


def latency_quantiles(cases: DataFrame) -> DataFrame:
    """Discrete quantiles of each pull request's largest latency; 0 where there is none."""
    worst = cases.groupBy("organization", "pull_request").agg(F.max("latency_ms").alias("latency_ms"))
    return worst.agg(*(_discrete(p, "latency_ms").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


def risk_coverage(cases: DataFrame, order: Column | None = None) -> DataFrame:
    """What selecting the strata up to each in their order would give: weighted selection coverage, actionable
    precision and findings per thousand pull requests (A15, W4). Only what is selected depends on the strata
    included; candidates and pull requests are those of all. Strata are summed before the window, which then
    runs over as many rows as there are strata."""
    counts, success, open_ = metric_rules()["actionable_precision"]
    full = counts & ~open_
    by = cases.groupBy("stratum").agg(
        F.sum(F.when(_selected(), C("weight")).otherwise(0.0)).alias("selected"), F.count_if(full).alias("n"), F.count_if(full & success).alias("k"),
        F.sum(F.when(C("detector_output").isin("candidate", "abstained"), C("weight")).otherwise(0.0)).alias("candidates"),
    )
    heaviest = cases.groupBy("organization", "pull_request").agg(F.max("weight").alias("weight"))
    population = F.broadcast(heaviest.agg(F.sum("weight").alias("population")))  # one row
    place = order if order is not None else C("stratum")
    upto = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = by.select("stratum", *(F.sum(c).over(upto).alias(c) for c in ("selected", "n", "k")), F.sum("candidates").over(every).alias("candidates")).join(population)
    return run.select(
        "stratum", C("n").alias("total"), C("k").alias("successes"), F.round(ratio(C("selected"), C("candidates")), 9).alias("selection_coverage"),
        F.round(ratio(C("k"), C("n")), 9).alias("actionable_precision"), F.round(ratio(C("selected") * 1000, C("population")), 9).alias("findings_per_thousand"),
    )


def team_burden(cases: DataFrame) -> DataFrame:
    """Alerted pull requests of every team for each day on which any pull request was opened, one day at least;
    days, not weeks, divide (A16)."""
    days = F.broadcast(cases.agg(F.greatest(F.count_distinct("opened_on"), F.lit(1)).alias("active")))  # one row
    alerted = cases.groupBy("team").agg(F.count_distinct(F.when(_selected(), C("pull_request"))).alias("alerted"))
    return alerted.join(days).withColumn("per_active_day", F.round(C("alerted") / C("active"), 9))


def distinct_counts(cases: DataFrame) -> DataFrame:
    """Exact distinct counts of organizations and of producer and consumer pairs."""
    return cases.agg(F.count_distinct("organization").alias("organizations"), F.count_distinct("producer", "consumer").alias("pairs"))


def usefulness(cases: DataFrame) -> DataFrame:
    """Cases whose action was looked for, those where it was seen, the discrete median of the time it took, and
    those censored (A13, A12)."""
    eligible, seen = F.count(C("action_observed")), F.count_if(F.coalesce("action_observed", F.lit(False)))
    return cases.agg(
        eligible.alias("eligible"), seen.alias("observed_actions"), F.round(ratio(seen, eligible), 9).alias("action_rate"),
        _discrete(0.5, "time_to_action_ms").alias("median_time_to_action"), F.count_if(F.coalesce("action_censored", F.lit(False))).alias("censored"),
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs(axis, a, b): raw agreement and Krippendorff's nominal alpha of each axis."""
    confusion = pairs.groupBy("axis", "a", "b").agg(F.count("*").alias("n"))
    totals = confusion.groupBy("axis").agg(F.sum("n").alias("pairs"), F.sum(F.when(C("a") == C("b"), C("n")).otherwise(0)).alias("equal"))
    ratings = confusion.select("axis", F.explode(F.array("a", "b")).alias("label"), "n").groupBy("axis", "label").agg(F.sum("n").alias("n"))
    expected = ratings.join(totals, "axis").groupBy("axis").agg(F.sum(F.pow(C("n") / (2 * C("pairs")), F.lit(2))).alias("expected"))
    observed = 1 - C("equal") / C("pairs")
    alpha = F.when(C("expected") == 1, 1.0).otherwise(1 - observed / (1 - C("expected")))
    return totals.join(expected, "axis").select("axis", "pairs", "equal", F.round(C("equal") / C("pairs"), 9).alias("raw_agreement"), F.round(alpha, 9).alias("alpha"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("axis", "a", "b").agg(F.count("*").alias("n"))


def review_chain(events: DataFrame) -> DataFrame:
    """Whether each event supersedes the latest of its subject before it."""
    w = Window.partitionBy("subject").orderBy("sequence")
    return events.withColumn("valid", F.coalesce(F.lag("event_id").over(w).eqNullSafe(C("supersedes")), F.lit(False)))
