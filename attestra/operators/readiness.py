"""Decisions: what a capability is built from, whether a case may start, whether context suffices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gates after the binding's, in order, with the status of each; the first that is not met decides.
GATES = {
    "framework_snapshot_ready": "BLOCKED_FRAMEWORK_STALE",
    "test_data_snapshot_ready": "BLOCKED_INVALID_TEST_DATA_DOCUMENT",
    "schema_conforms": "BLOCKED_INVALID_TEST_DATA_DOCUMENT",
    "bundle_available": "BLOCKED_MISSING_DATA",
    "all_inputs_resolved": "BLOCKED_MISSING_DATA",
    "oracles_present": "BLOCKED_MISSING_DATA",
    "setup_and_cleanup_defined": "BLOCKED_MISSING_DATA",
    "all_actions_mapped": "BLOCKED_MISSING_CAPABILITY",
    "decisions_approved": "BLOCKED_AMBIGUOUS_SPEC",
    "framework_modifications_authorized": "BLOCKED_AUTHORIZATION",
    "dependencies_available": "BLOCKED_DEPENDENCY",
    "worktree_matches_index": "BLOCKED_FRAMEWORK_STALE",
    "safety_satisfied": "BLOCKED_AUTHORIZATION",
    "scenario_approved": "BLOCKED_MISSING_DATA",
    "traceability_valid": "BLOCKED_MISSING_DATA",
    "execution_profile_selected": "BLOCKED_MISSING_DATA",
}
#: What binding resolution may say for the gates to be asked.
BINDING_PASSES = ("READY", "NOT_APPLICABLE")
BINDING_CHECK = "scenario_data_binding"
NO_CAPABILITY = "BLOCKED_MISSING_CAPABILITY"


def decide_capability(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(scenario_id, capability_id, authorized) and candidates (..., pos, fqn, match_kind) to (..., decision, selected, blocker).

    The first exact match is reused; of two partial ones or more the first is composed; the
    first compatible one is wrapped; what is authorized is implemented; the rest is blocked,
    an asked capability without candidates too.
    """
    keys = ["scenario_id", "capability_id"]
    first = lambda kind: F.min(F.when(F.col("match_kind") == kind, F.struct("pos", "fqn")))["fqn"].alias(kind)
    counts = candidates.groupBy(*keys).agg(first("exact"), first("compatible"), first("partial"), F.count_if(F.col("match_kind") == "partial").alias("n_partial"))
    decision = F.when(F.col("exact").isNotNull(), "reuse").when(F.col("n_partial") >= 2, "compose").when(F.col("compatible").isNotNull(), "wrap").when(F.col("authorized"), "implement")
    decided = asked.join(counts, keys, "left").withColumn("decision", decision)
    selected = F.when(F.col("decision") == "reuse", F.col("exact")).when(F.col("decision") == "compose", F.col("partial")).when(F.col("decision") == "wrap", F.col("compatible"))
    return decided.select(*keys, "decision", selected.alias("selected"), F.when(F.col("decision").isNull(), NO_CAPABILITY).alias("blocker"))


def readiness(gates: DataFrame) -> DataFrame:
    """``gates`` with ``readiness`` and ``failed_check``: the binding's status if that stops all, else the first gate not met, else READY.

    A framework modification must be authorized only where ``framework_modification_required``.
    A gate that is null is not met.
    """
    met = lambda name: F.coalesce(F.col(name), F.lit(False))
    state, failed = F.lit("READY"), F.lit(None).cast("string")
    for name, blocked in reversed(GATES.items()):
        ok = met(name)
        if name == "framework_modifications_authorized":
            ok = ok | ~met("framework_modification_required")
        state, failed = F.when(~ok, blocked).otherwise(state), F.when(~ok, name).otherwise(failed)
    bound = F.coalesce(F.col("binding_status").isin(*BINDING_PASSES), F.lit(False))
    return gates.withColumn("readiness", F.when(bound, state).otherwise(F.col("binding_status"))).withColumn("failed_check", F.when(bound, failed).otherwise(BINDING_CHECK))


def sufficiency(worktree_matches: Column, bundle_resolved: Column, data_reasons: Column, actions_have_capability: Column, unresolved: Column) -> Column:
    """(status, reasons): what the data lack hides what capabilities lack."""
    data = F.concat(
        F.when(worktree_matches, F.array().cast("array<string>")).otherwise(F.array(F.lit("worktree hashes do not match the indexed snapshot; reindex required"))),
        F.when(bundle_resolved, F.array().cast("array<string>")).otherwise(F.array(F.lit("resolved test-data bundle is not available"))),
        F.coalesce(data_reasons, F.array().cast("array<string>")),
    )
    gaps = F.transform(unresolved, lambda c: F.concat(F.lit("capability '"), c, F.lit("' is unmapped")))
    gaps = F.when(F.coalesce(F.size(unresolved), F.lit(0)) > 0, gaps).otherwise(F.array(F.lit("one or more scenario actions have no mapped capability")))
    lacks = F.size(data) > 0
    status = F.when(lacks, "SPEC_DATA_MISSING").when(~actions_have_capability, "CAPABILITY_MISSING").otherwise("SUFFICIENT")
    reasons = F.when(lacks, data).when(~actions_have_capability, gaps).otherwise(F.array().cast("array<string>"))
    return F.struct(status.alias("status"), reasons.alias("reasons"))


def run_status(cases: DataFrame) -> DataFrame:
    return cases.groupBy("run_id").agg(F.when(F.every(F.col("status") == "ACCEPTED"), "COMPLETED").otherwise("PARTIAL_FAILED").alias("run_status"))


def run_exit(frozen: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, run_status) of runs whose results are those of the frozen scenarios, in their order; another id, place or number fails the job.

    ``frozen`` is (run_id, pos, scenario_id), ``results`` (run_id, pos, scenario_id, status);
    places count from the same number. They meet by run and place.
    """
    expected = frozen.select("run_id", "pos", F.col("scenario_id").alias("_expected"))
    both = expected.join(results.select("run_id", "pos", F.col("scenario_id").alias("_found"), "status"), ["run_id", "pos"], "full")
    message = F.concat(F.lit("run "), F.col("run_id").cast("string"), F.lit(" at "), F.col("pos").cast("string"), F.lit(": expected "), F.coalesce("_expected", F.lit("nothing")), F.lit(", received "), F.coalesce("_found", F.lit("nothing")))
    return run_status(both.filter(F.when(F.col("_expected") == F.col("_found"), True).otherwise(F.raise_error(message).cast("boolean"))))


#: States of a snapshot.
BUILDING, READY, FAILED = "building", "ready", "failed"


def latest_snapshot(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """The ready snapshot of each key: an active one first, then the newest, then by id."""
    from attestra.operators.store import latest

    return latest(snapshots.filter(F.col("status") == READY), keys, [F.col("active").desc(), F.col("created_at").desc(), F.col("snapshot_id")])


def snapshot_problems(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(relative_path, problem): files of a snapshot that are missing or have another hash."""
    found = files.select("relative_path", F.col("content_hash").alias("found"))
    joined = expected.join(found, "relative_path", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("content_hash"), "changed")
    return joined.select("relative_path", problem.alias("problem")).filter("problem IS NOT NULL")


def activate(snapshots: DataFrame, snapshot_id: str, problems: DataFrame) -> DataFrame:
    """``snapshots`` with one that was building ready and active, and the others of its repository inactive.

    One that is ready and active already stays as it is. An unknown id, another state and any
    row of ``problems`` (``snapshot_problems``) are errors, and nothing is activated.
    """
    states = [(r["status"], r["active"]) for r in snapshots.filter(F.col("snapshot_id") == snapshot_id).select("status", "active").limit(2).collect()]
    if not states:
        raise ValueError(f"unknown snapshot: {snapshot_id}")
    if (READY, True) in states:
        return snapshots
    if states[0][0] != BUILDING:
        raise ValueError(f"snapshot {snapshot_id} is {states[0][0]}, expected {BUILDING}")
    if found := problems.limit(20).collect():
        raise ValueError(f"snapshot {snapshot_id} is not what was extracted: {[(r['relative_path'], r['problem']) for r in found]}")
    own = F.col("snapshot_id") == snapshot_id
    ours = snapshots.filter(own).select(F.col("repository_id").alias("_ours")).distinct()
    joined = snapshots.join(F.broadcast(ours), F.col("repository_id") == F.col("_ours"), "left")  # one row
    active = F.when(own, True).when(F.col("_ours").isNotNull(), False).otherwise(F.col("active"))
    return joined.withColumn("status", F.when(own, READY).otherwise(F.col("status"))).withColumn("active", active).select(*snapshots.columns)


def mark_failed(snapshots: DataFrame, snapshot_id: str) -> DataFrame:
    """A snapshot that isn't ready becomes failed and inactive."""
    own = (F.col("snapshot_id") == snapshot_id) & (F.col("status") != READY)
    return snapshots.withColumn("active", F.when(own, False).otherwise(F.col("active"))).withColumn("status", F.when(own, FAILED).otherwise(F.col("status")))
