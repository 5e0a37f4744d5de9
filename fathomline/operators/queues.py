"""Durable queues as pure transitions over state tables, and running budgets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.canonical import hash_record, whole
from ..sources.tables import shared_dir

C = F.col


def dedupe_inbox(deliveries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first delivery of each key (ST1): an aggregate, combined before the shuffle."""
    rest = [c for c in deliveries.columns if c not in (*key, *order)]
    first = deliveries.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("f"), F.count("*").alias("deliveries"))
    return first.select(*key, *(F.col(f"f.{c}") for c in (*order, *rest)), "deliveries")


def claim(jobs: DataFrame, lane: list[str], now: Column) -> DataFrame:
    """The next job of each lane: available, or leased and expired, attempts left, earliest first (ST2, O5)."""
    open_ = (C("state") == "available") | (C("state") == "leased") & (C("lease_expires_at") <= now)
    ready = jobs.where(open_ & (C("available_at") <= now) & (C("attempt") < C("maximum_attempts")))
    rest = [c for c in jobs.columns if c not in (*lane, "available_at", "event_id")]
    best = ready.groupBy(*lane).agg(F.min(F.struct("available_at", "event_id", *rest)).alias("b"))
    return best.select(*lane, "b.event_id", "b.available_at", (C("b.attempt") + 1).alias("attempt"), F.lit("leased").alias("state"))


def settle(jobs: DataFrame, outcomes: DataFrame, worker: str = "lease_owner") -> DataFrame:
    """States after outcomes: completed, retry_scheduled, failed, or stale where the lease is another's (ST3)."""
    joined = jobs.join(outcomes, "event_id")
    after = (
        F.when((C("state") != "leased") | (C(worker) != C("reporter")), "stale_claim")
        .when(C("succeeded"), "completed")
        .when(C("attempt") < C("maximum_attempts"), "retry_scheduled")
        .otherwise("failed")
    )
    return joined.select("event_id", after.alias("after"))


def supersede(jobs: DataFrame, key: str, order: list) -> DataFrame:
    """Waiting jobs with the newest of their key kept and the others superseded (ST4, ST6)."""
    waiting = jobs.where(C("state").isin("available", "leased"))
    newest = waiting.groupBy(key).agg(F.max(F.struct(*order)).alias("newest"))
    return waiting.join(newest, key).withColumn("after", F.when(F.struct(*order) == C("newest"), C("state")).otherwise("superseded")).drop("newest")


#: The job that each kind of event asks for.
ROUTES = {"push": "index_generation", "check_run": "record_review", "installation": "reconcile_provider", "installation_repositories": "reconcile_provider"}


def route(events: DataFrame, workspace: str) -> DataFrame:
    """Jobs that events(event_id, event_type, action, repository, ref, pull_request) ask for (ST5), with the key
    under which analyses of one pull request and generations of one ref replace one another. A closed pull
    request is reconciled; an event that is not supported has no job but a failure."""
    job = F.coalesce(*(F.when(C("event_type") == e, F.lit(j)) for e, j in ROUTES.items()), F.when(C("event_type") == "pull_request", F.when(C("action") == "closed", "reconcile_provider").otherwise("analyze_pull_request")))
    own = {"workspaceId": F.lit(workspace), "repositoryId": C("repository"), "kind": C("job")}
    key = F.when(C("job") == "analyze_pull_request", hash_record(own | {"pullRequestNumber": whole(C("pull_request"))})).when(
        C("job") == "index_generation", hash_record(own | {"ref": F.coalesce("ref", F.lit("unknown"))})
    )
    routed = events.withColumn("job", job)
    return routed.select("event_id", "job", key.alias("supersession_key"), F.when(C("job").isNull(), "unsupported_webhook_event").alias("failure"))


def running_budget(requests: DataFrame, lane: list[str], order: list[str], amount: str, limit: float) -> DataFrame:
    """Usage of each lane so far, whether a request fits, and whether it is the lane's first that doesn't (A30,
    W5). Amounts are summed in blocks of a lane's order before the window runs, so a lane of any length is
    spread over tasks: the running sum within a block is added to that of the blocks before it."""
    width = 1 << 16
    block = F.floor(C(order[0]) / width)
    rows = requests.select(*lane, *order, amount).withColumn("_block", block)
    sums = rows.groupBy(*lane, "_block").agg(F.sum(amount).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*lane).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*lane, "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    w = Window.partitionBy(*lane, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = (F.sum(amount).over(w) + C("_start")).alias("used")
    run = rows.join(starts, [*lane, "_block"]).select(*lane, *order, amount, used)
    first = run.where(C("used") > limit).groupBy(*lane).agg(F.min(F.struct(*order)).alias("_first"))
    joined = run.join(first, lane, "left")
    return joined.select(*lane, *order, amount, "used", (C("used") <= limit).alias("granted"), F.coalesce(F.struct(*order) == C("_first"), F.lit(False)).alias("exhausts"))


#: What an execution's budget limits, in the order in which limits are looked at.
DIMENSIONS = ["latency_ms", "provider_requests", "source_bytes", "storage_queries", "artifacts", "model_tokens"]


def settle_budgets(log: DataFrame, limits: DataFrame) -> DataFrame:
    """Usage of each run and dimension after its log(run_id, lane, step, kind, dimension, amount) of reservations
    and releases, and what was exhausted (A30). A reservation that would exceed its limit takes nothing; a
    release gives back. What a step may take depends on the steps before it, so the steps of a run and
    dimension, which a budget bounds, are folded in order."""
    steps = log.groupBy("run_id", "lane", "dimension").agg(F.array_sort(F.collect_list(F.struct("step", "kind", "amount"))).alias("steps")).join(limits, ["lane", "dimension"])
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("exhausted"))

    def fold(acc: Column, s: Column) -> Column:
        over = (s["kind"] == "reserve") & (acc["used"] + s["amount"] > C("limit"))
        used = F.when(s["kind"] == "release", F.greatest(acc["used"] - s["amount"], F.lit(0).cast("long"))).when(over, acc["used"]).otherwise(acc["used"] + s["amount"])
        return F.struct(used.alias("used"), (acc["exhausted"] | over).alias("exhausted"))

    return steps.withColumn("end", F.aggregate("steps", zero, fold)).select("run_id", "lane", "dimension", "limit", "end.used", "end.exhausted")


def breaker(attempts: DataFrame, key: list[str], order: list[str], threshold: int) -> DataFrame:
    """Whether so many consecutive failures stand at each attempt (ST10): failures since the last success, as a
    count within runs that successes separate."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = attempts.withColumn("_run", F.sum((~C("failed")).cast("int")).over(w))
    inside = Window.partitionBy(*key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    streak = marked.withColumn("streak", F.sum(C("failed").cast("int")).over(inside))
    return streak.withColumn("open", C("streak") >= threshold).drop("_run")


#: State of a breaker that has seen nothing: failures in a row, and until when it is open.
CLOSED = (0, 0)


def _after(state: tuple, at, outcome, threshold: int, cooldown_ms: int) -> tuple[tuple, str]:
    """A breaker's state after an attempt, and what became of that. Failures beyond the threshold are not counted on."""
    n, until = state
    if at is not None and at < until:
        return state, "circuit_open"
    if outcome == "provider_failure":
        n = min(n + 1, threshold)
        if n >= threshold and at is not None:
            return (n, at + cooldown_ms), "opened"
    elif outcome == "ok":
        n, until = 0, until if at is None else 0
    return (n, until), "tried"


def breaker_with_cooldown(attempts: DataFrame, key: list[str], order: list[str], threshold: int, cooldown_ms: int) -> DataFrame:
    """What becomes of each attempt(at_ms, outcome: ok, provider_failure or other) behind a breaker (ST10): while
    it is open an attempt isn't made, and changes nothing; a failure of the provider that makes `threshold` in
    a row, or follows on as many, opens it for the cooldown; a success closes it.

    A provider's attempts are a sequence, but no task folds a whole one: attempts are laid out by ranges of key and
    order, all ranges are folded at once from a closed breaker, and a range whose provider began in the range before
    is folded again from the state that one ended in, until every state is what it was taken for. A success, or a
    pause, makes states agree, so two or three rounds are usual; at worst a round settles one more range. The driver
    sees a range's ends, and of them only states."""
    spark = attempts.sparkSession
    shared_dir(spark)
    by = list(dict.fromkeys([*key, *order, "at_ms", "outcome"]))
    # Checkpoints keep partitions and their order, which files that are read again do not.
    laid = attempts.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).checkpoint()
    laid = laid.select(F.spark_partition_id().alias("_part"), *by)
    at, outcome, keys = by.index("at_ms") + 1, by.index("outcome") + 1, range(1, len(key) + 1)
    kept = [by.index(c) + 1 for c in (*key, *order)]

    def folded(batches, entries):
        """For each batch: its range, the first and last key so far, the state, and what became of the attempts."""
        part = first = last = state = None
        for b in batches:
            if not b.num_rows:
                continue
            if part is None:
                part = b.column(0)[0].as_py()
            said = []
            for own, when, what in zip(zip(*(b.column(i).to_pylist() for i in keys)), b.column(at).to_pylist(), b.column(outcome).to_pylist(), strict=True):
                if own != last or state is None:
                    state = entries.get(part, CLOSED) if state is None else CLOSED
                    first, last = own if first is None else first, own
                state, result = _after(state, when, what, threshold, cooldown_ms)
                said.append(result)
            yield b, part, first, last, state, said

    def ends(entries):
        def run(batches):
            end = None
            for end in folded(batches, entries):
                pass
            if end is not None:
                _, part, first, last, state, _ = end
                row = [part, repr(first), repr(last), *entries.get(part, CLOSED), *state]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "first", "last", "n", "until", "end_n", "end_until"])

        return run

    def told(entries):
        def run(batches):
            for b, *_, said in folded(batches, entries):
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(said, pa.string())], names=[*key, *order, "result"])

        return run

    span, known, entries, asked = {}, {}, {}, None
    while asked is None or asked:
        rows = laid if asked is None else laid.where(C("_part").isin(sorted(asked)))
        for r in rows.mapInArrow(ends(asked or {}), "part long, first string, last string, n long, until long, end_n long, end_until long").collect():
            span[r["part"]] = (r["first"], r["last"])
            known.setdefault(r["part"], {})[r["n"], r["until"]] = (r["end_n"], r["end_until"])
        asked, state, before = {}, CLOSED, None
        for part, (first, last) in sorted(span.items()):
            entries[part] = entry = state if first == before else CLOSED
            if first == last and entry not in known[part]:
                asked[part] = entry
            state, before = known[part].get(entry, next(iter(known[part].values()))), last
    return laid.mapInArrow(told(entries), StructType([*attempts.select(*key, *order).schema, StructField("result", StringType())]))


def revoke(disclosures: DataFrame, revisions: DataFrame) -> DataFrame:
    """Disclosures with those of revoked revisions marked (ST11, S17)."""
    gone = revisions.select("revision", F.lit(True).alias("revoked")).distinct()
    return disclosures.join(gone, "revision", "left").withColumn("revoked", F.coalesce("revoked", F.lit(False)))


def append_numbers(held: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Numbers for rows to append to logs: each key's go on from its highest so far."""
    top = held.groupBy(key).agg(F.max("sequence").alias("_top"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return incoming.withColumn("_n", n).join(top, key, "left").withColumn("sequence", F.coalesce("_top", F.lit(0)) + C("_n")).drop("_top", "_n")


def kill_switch(deliveries: DataFrame, switches: DataFrame) -> DataFrame:
    """Deliveries that wait are held while a switch for all or for their lane is on (ST11)."""
    on = switches.where("engaged").select(C("lane").alias("_lane")).distinct()
    every = F.broadcast(on.agg(F.coalesce(F.bool_or(C("_lane") == "*"), F.lit(False)).alias("_all")))
    joined = deliveries.join(every).join(on, C("lane") == C("_lane"), "left")
    held = (C("state") == "available") & (C("_all") | C("_lane").isNotNull())
    return joined.withColumn("state", F.when(held, "held").otherwise(C("state"))).drop("_all", "_lane")
