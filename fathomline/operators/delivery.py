"""What of an analysis is shown: disclosure, promoted strata, annotations, and the advisory check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Findings and annotations that a check shows at most; the rest is counted.
FINDINGS, ANNOTATIONS = 20, 50


def disclose(facts: DataFrame, audience: Column) -> DataFrame:
    """facts(explicit_grant, app_can_read, whole_audience_can_read, viewer_can_read) each allowed, or the first
    reason for which it is left out (P14)."""
    reason = (
        F.when(~C("explicit_grant"), "no_explicit_grant")
        .when(~C("app_can_read"), "app_access_denied")
        .when((audience == "static") & ~C("whole_audience_can_read"), "whole_audience_safety_unproven")
        .when((audience == "personalized") & ~C("viewer_can_read"), "viewer_access_denied")
    )
    return facts.withColumn("omitted", reason).withColumn("allowed", C("omitted").isNull())


def provider_authorization(requests: DataFrame, members: DataFrame, consents: DataFrame, grants: DataFrame) -> DataFrame:
    """requests(subject, action, repository) allowed by the selection of the repository, the last consent that
    matches (its grantee the subject or anyone), and what the provider grants; writing to consumers never is
    (P13)."""
    key = ["subject", "action", "repository"]
    fit = requests.select(*key).join(consents, ["action", "repository"], "left").where(C("grantee").isNull() | C("grantee").isin("*") | (C("grantee") == C("subject")))
    last = fit.groupBy(*key).agg(F.max(F.when(C("grantee").isNotNull(), F.struct("position", "decision"))).alias("last"))
    joined = requests.join(last, key, "left").join(members.select("repository", C("selected").alias("_selected")), "repository", "left")
    joined = joined.join(grants.select("repository", "app_can_read", "app_can_write_checks"), "repository", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    provider = F.when(C("action") == "producer_check.write", yes(C("app_can_write_checks"))).when(C("action") == "consumer.write", False).otherwise(yes(C("app_can_read")))
    reason = (
        F.when(C("_selected").isNull(), "not_in_current_workspace_scope")
        .when(~C("_selected"), "repository_not_selected")
        .when(~yes(C("last.decision") == "allow"), "current_consent_denied")
        .when(~provider, "current_provider_grant_denied")
        .otherwise("current_consent_and_provider_grant")
    )
    return joined.select(*key, (reason == "current_consent_and_provider_grant").alias("allowed"), reason.alias("reason"))


def promoted_strata(promotions: DataFrame, current: DataFrame, enabled: DataFrame) -> DataFrame:
    """Enabled strata whose latest promotion stands, and for the versions that are current now."""
    latest = promotions.groupBy("stratum_key").agg(F.max(F.struct("decided_at", "state", "versions")).alias("last"))
    joined = enabled.select("stratum_key").distinct().join(latest, "stratum_key").join(current.select("stratum_key", C("versions").alias("_now")), "stratum_key")
    return joined.where((C("last.state") == "PROMOTED") & (C("last.versions") == C("_now"))).select("stratum_key", "last.decided_at")


def delivered(findings: DataFrame, promoted: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Findings that a check may show: not abstained, not suppressed, of a promoted stratum, and disclosed."""
    shown = findings.where("state <> 'ABSTAINED' and not suppressed")
    return shown.join(promoted.select("stratum_key"), "stratum_key", "left_semi").join(disclosures.select("fingerprint").distinct(), "fingerprint", "left_semi")


def annotations(findings: DataFrame, locations: DataFrame) -> DataFrame:
    """Where findings are noted: at their location, if its first and last lines are among the lines that were
    changed exactly (J20). The first location of a fingerprint counts."""
    at = locations.groupBy("fingerprint").agg(F.min(F.struct("position", "path", "start_line", "end_line", "changed_lines")).alias("l")).select("fingerprint", "l.*")
    sound = (C("start_line") >= 1) & (C("end_line") >= C("start_line")) & F.array_contains("changed_lines", C("start_line")) & F.array_contains("changed_lines", C("end_line"))
    return findings.select("fingerprint").join(at, "fingerprint").where(sound).select("fingerprint", "path", "start_line", "end_line")


def cap(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows of an order and how many were left out (O3)."""
    total = rows.agg(F.count("*").alias("_total"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.greatest(C("_total") - limit, F.lit(0))).drop("_total")  # one row


def check_coverage(states: DataFrame, abstentions: DataFrame) -> DataFrame:
    """What a check says of its consumers."""
    counted = states.agg(
        F.count_if(C("consumer_state") == "current").alias("current_consumers"), F.count_if(C("consumer_state") == "unauthorized").alias("permission_limited_consumers"),
        F.count_if(C("consumer_state") == "failed").alias("failed_consumers"),
    )
    return counted.join(F.broadcast(abstentions.agg(F.count("*").alias("abstentions"))))  # one row each


def plan_checks(analyses: DataFrame) -> DataFrame:
    """Whether each analysis may write its check, and what the check concludes (O3 and around it):
    analyses(analysis_id, in_scope, head, current_head, is_current, write_authorized, kill_switch,
    advisory_enabled, promoted, findings, state, timed_out)."""
    incomplete = C("timed_out") | C("state").isin("partial", "not_analysed")
    conclusion = F.when(~C("in_scope"), "skipped").when(incomplete | (C("findings") > 0), "neutral").otherwise("success")
    reason = (
        F.when(~C("in_scope"), "repository_out_of_scope")
        .when((C("head") != C("current_head")) | ~C("is_current"), "superseded_head")
        .when(~C("write_authorized"), "write_unauthorized")
        .when(C("kill_switch"), "write_kill_switch")
        .when(C("promoted") == 0, "no_promoted_strata")
        .when(~C("advisory_enabled"), "shadow_mode")
        .otherwise("advisory_enabled")
    )
    mode = F.when(C("_reason") == "advisory_enabled", "write").when(C("_reason") == "shadow_mode", "shadow").otherwise("no_write")
    return analyses.withColumn("_reason", reason).select(
        "analysis_id", mode.alias("mode"), C("_reason").alias("reason"), conclusion.alias("conclusion"), F.greatest(C("findings") - FINDINGS, F.lit(0)).alias("truncated_findings")
    )


def annotation_batches(rows: DataFrame, size: int = ANNOTATIONS, most: int = 60_000) -> DataFrame:
    """Annotations of each analysis in batches of so many, their text cut to what a provider takes (S16). What a
    check holds is bounded, so a check's rows are numbered together."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("analysis_id").orderBy("path", "start_line", "fingerprint")) - 1
    return rows.withColumn("_n", at).select("analysis_id", F.floor(C("_n") / size).alias("batch"), "fingerprint", "path", "start_line", F.substring("message", 1, most).alias("message")) 
