"""Checks of structured test data: issue rows, references, bindings and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.ids import json_checksum
from attestra.functions.json_text import explode_leaves, is_placeholder, is_plain_secret

ISSUE_COLUMNS = ("issue_code", "severity", "message", "record_id", "sheet", "row", "cell")
#: Which record type a binding's reference must have.
REFERENCE_TYPES = {
    "execution_profile_id": "ExecutionProfile", "fixture_id": "Fixture", "cleanup_id": "Cleanup", "oracle_ids": "Oracle", "test_vector_ids": "TestVector",
    "action_sequence_id": "Action", "timing_policy_id": "TimingPolicy", "fault_profile_ids": "FaultProfile", "safety_rule_ids": "SafetyRule",
}
APPROVED = "APPROVED"
DEFAULT_VARIANT = "default"
MISSING_BINDING, AMBIGUOUS_BINDING, READY = "BLOCKED_MISSING_DATA", "BLOCKED_AMBIGUOUS_BINDING", "READY"
#: Ids of a binding that name no record.
NO_RECORD_KEYS = ("binding_id", "scenario_id", "execution_profile_id")


def issues(rows: DataFrame, code: str, severity: str, message: Column, record: str = "record_id", cell: Column | None = None) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    has = rows.columns
    return rows.select(
        F.lit(code).alias("issue_code"), F.lit(severity).alias("severity"), message.alias("message"), F.col(record).alias("record_id"),
        (F.col("source_sheet") if "source_sheet" in has else null("string")).alias("sheet"), (F.col("source_row") if "source_row" in has else null("int")).alias("row"), (cell if cell is not None else null("string")).alias("cell"),
    )


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def later_occurrences(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Every occurrence of a key after its first."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("occurrence", F.row_number().over(w)).filter("occurrence > 1")


def references(bindings: DataFrame) -> DataFrame:
    """(binding_id, field, record_id, expected_type), one row a reference; of the columns that the table has."""
    out = None
    for field, kind in REFERENCE_TYPES.items():
        if field not in bindings.columns:
            continue
        value = F.explode(field) if field.endswith("_ids") else F.col(field)
        one = bindings.select("binding_id", F.lit(field).alias("field"), value.alias("record_id"), F.lit(kind).alias("expected_type")).filter("record_id IS NOT NULL AND record_id <> ''")
        out = one if out is None else out.unionByName(one)
    return out


def payload_references(leaves: DataFrame, key: str = "binding_id") -> DataFrame:
    """(key, ids): values of a payload's own fields that end in _id or _ids, each once in order; a binding's own ids aside.

    ``leaves`` is (key, pos, path, key, kind, value) of payloads, the payload's owner in column ``key``.
    """
    field = F.regexp_extract("path", r"^([^.\[]+)(?:\[\d+\])?$", 1)
    single = field.endswith("_id") & ~field.isin(*NO_RECORD_KEYS) & (F.col("path") == field) & (F.col("kind") == "string")
    several = field.endswith("_ids") & (F.col("path") != field)
    found = leaves.filter((single | several) & (F.col("kind") != "null") & (F.col("value") != ""))
    first = found.groupBy(F.col(key).alias("owner"), F.col("value").alias("record_id")).agg(F.min("pos").alias("pos"))
    held = first.groupBy(F.col("owner").alias(key)).agg(F.array_sort(F.collect_list(F.struct("pos", "record_id"))).alias("held"))
    return held.select(key, F.transform("held", lambda x: x["record_id"]).alias("ids"))


def reference_issues(refs: DataFrame, records: DataFrame) -> DataFrame:
    """References to no record, to one of another type, or to one that is not approved; an issue is of the binding.

    Of records with one id the first counts, by sheet and row where they have them.
    """
    order = [F.col(c) for c in ("source_sheet", "source_row") if c in records.columns] or [F.col("record_type")]
    first = Window.partitionBy("record_id").orderBy(*order)
    status = F.col("record_status") if "record_status" in records.columns else F.lit(APPROVED)
    known = records.withColumn("n", F.row_number().over(first)).filter("n = 1").select("record_id", "record_type", status.alias("status"))
    joined = refs.join(known, "record_id", "left")
    said = lambda *parts: F.concat(F.lit("binding '"), F.col("binding_id"), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    missing = issues(joined.filter("record_type IS NULL"), "REFERENCE_MISSING_FK", "ERROR", said("' references unknown record '", F.col("record_id"), "'"), record="binding_id")
    wrong = issues(joined.filter("record_type <> expected_type"), "REFERENCE_WRONG_TYPE", "ERROR", said("' expects ", F.col("expected_type"), " for '", F.col("record_id"), "' but found ", F.col("record_type")), record="binding_id")
    draft = issues(joined.filter(f"record_type = expected_type AND status <> '{APPROVED}'"), "SEMANTIC_UNAPPROVED_RECORD", "ERROR", said("' references non-APPROVED '", F.col("record_id"), "'"), record="binding_id")
    return missing.unionByName(wrong).unionByName(draft)


def validate(records: DataFrame, bindings: DataFrame, scenarios: DataFrame) -> DataFrame:
    """All issues of a test-data set."""
    twice = duplicate_keys(records, "record_id")
    leaves = explode_leaves(records.select("record_id", "source_sheet", "source_row", "payload"), "payload")
    shown = F.when(F.trim("value") == "", F.lit("<blank>")).otherwise(F.trim("value"))
    bound = bindings.filter(F.col("approval_status") == APPROVED).select("scenario_id").distinct()
    of_record = lambda *parts: F.concat(F.lit("record '"), F.col("record_id"), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    found = [
        issues(twice, "IDENTITY_DUPLICATE_RECORD_ID", "ERROR", F.concat(F.lit("record_id '"), F.col("record_id"), F.lit("' appears "), F.col("n").cast("string"), F.lit(" times"))),
        issues(leaves.filter((F.col("kind") == "string") & is_placeholder(F.col("value"))), "SEMANTIC_PLACEHOLDER_VALUE", "ERROR", of_record("' contains placeholder value '", shown, "'"), cell=F.col("path")),
        issues(leaves.filter(is_plain_secret(F.col("key"), F.col("value"), F.col("kind"))), "SEMANTIC_PLAINTEXT_SECRET", "ERROR", of_record("' field '", F.lower("key"), "' must contain a secret:// reference"), cell=F.col("path")),
        reference_issues(references(bindings), records),
        issues(scenarios.join(bound, "scenario_id", "left_anti"), "COVERAGE_NO_BINDING", "ERROR", F.concat(F.lit("scenario '"), F.col("scenario_id"), F.lit("' has no approved binding")), record="scenario_id"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def gate(found: DataFrame) -> DataFrame:
    """One row: BLOCKED if any issue is an error."""
    return found.agg(F.when(F.coalesce(F.bool_or(F.col("severity") == "ERROR"), F.lit(False)), "BLOCKED").otherwise("READY").alias("status"))


def resolve_bindings(asked: DataFrame, bindings: DataFrame) -> DataFrame:
    """(scenario_id, execution_profile_id, variant_id) to (..., status, binding_id, candidates).

    Applicable are approved bindings of the same scenario, profile and variant (a null
    variant is the default one). None is missing data; one, or one alone of the highest
    priority, is ready; else the best ones, by id, are the candidates of an ambiguity.
    """
    keys = ["scenario_id", "execution_profile_id", "variant_id"]
    whole = lambda df: df.withColumn("variant_id", F.coalesce("variant_id", F.lit(DEFAULT_VARIANT)))
    approved = whole(bindings.filter(F.col("approval_status") == APPROVED)).select(*keys, "binding_id", "selection_priority")
    best = approved.groupBy(*keys, "selection_priority").agg(F.array_sort(F.collect_list("binding_id")).alias("ids")).groupBy(*keys).agg(F.max_by("ids", "selection_priority").alias("ids"))
    joined = whole(asked).select(*keys).join(best, keys, "left")
    one = F.size("ids") == 1
    status = F.when(F.col("ids").isNull(), MISSING_BINDING).when(one, READY).otherwise(AMBIGUOUS_BINDING)
    none = F.array().cast("array<string>")
    return joined.select(*keys, status.alias("status"), F.when(one, F.get("ids", F.lit(0))).alias("binding_id"), F.when(F.size("ids") > 1, F.col("ids")).otherwise(none).alias("candidates"))


def select_binding(asked: DataFrame, bindings: DataFrame) -> DataFrame:
    """(scenario_id, execution_profile_id, variant_id, binding_id) to (..., status): a named binding must be there once, approved, and fit; others are resolved."""
    keys = ["scenario_id", "execution_profile_id", "variant_id"]
    whole = asked.withColumn("variant_id", F.coalesce("variant_id", F.lit(DEFAULT_VARIANT)))
    fits = (F.col("approval_status") == APPROVED) & (F.col("b_scenario") == F.col("scenario_id")) & (F.col("b_profile") == F.col("execution_profile_id")) & (F.col("b_variant") == F.col("variant_id"))
    there = bindings.groupBy("binding_id").agg(
        F.count("*").alias("n"), F.first("approval_status").alias("approval_status"), F.first("scenario_id").alias("b_scenario"),
        F.first("execution_profile_id").alias("b_profile"), F.first(F.coalesce("variant_id", F.lit(DEFAULT_VARIANT))).alias("b_variant"),
    )
    named = whole.filter("binding_id IS NOT NULL").join(there, "binding_id", "left")
    status = F.when(F.coalesce("n", F.lit(0)) != 1, "unavailable").when(F.coalesce(fits, F.lit(False)), READY).otherwise("does_not_match")
    found = resolve_bindings(whole.filter("binding_id IS NULL"), bindings)
    return named.select(*keys, "binding_id", status.alias("status")).unionByName(found.select(*keys, "binding_id", "status"))


def select_variant(bindings: DataFrame, profile: str, scenarios: DataFrame | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """(scenario_id, variant_id, status) by the approved bindings of ``profile``.

    A variant named in ``explicit`` (scenario_id, variant_id) must be there; else a sole
    one is selected; several, or none, need a decision. A null variant is the default one.
    """
    approved = bindings.filter((F.col("approval_status") == APPROVED) & (F.col("execution_profile_id") == profile))
    grouped = approved.groupBy("scenario_id").agg(F.array_sort(F.collect_set(F.coalesce("variant_id", F.lit(DEFAULT_VARIANT)))).alias("variants"))
    of = (scenarios if scenarios is not None else bindings).select("scenario_id").distinct().join(grouped, "scenario_id", "left")
    named = F.lit(None).cast("string")
    if explicit is not None:
        of, named = of.join(explicit.select("scenario_id", F.col("variant_id").alias("named")), "scenario_id", "left"), F.col("named")
    n, there = F.coalesce(F.size("variants"), F.lit(0)), F.coalesce(F.array_contains("variants", named), F.lit(False))
    status = F.when(named.isNotNull(), F.when(there, "selected").otherwise("unknown_variant")).when(n == 1, "selected").when(n > 1, "several").otherwise("none")
    chosen = F.when(named.isNotNull(), F.when(there, named)).when(n == 1, F.get("variants", F.lit(0)))
    return of.select("scenario_id", chosen.alias("variant_id"), status.alias("status"))


def binding_coverage(scenarios: DataFrame, bindings: DataFrame, records: DataFrame) -> DataFrame:
    """Per scenario: number of approved bindings, whether there is any, whether any has an oracle, any a cleanup among the records."""
    known = records.select(F.col("record_id").alias("cleanup_id")).distinct().withColumn("there", F.lit(True))
    approved = bindings.filter(F.col("approval_status") == APPROVED).join(known, "cleanup_id", "left")
    n = approved.groupBy("scenario_id").agg(F.count("*").alias("n"), F.bool_or(F.size("oracle_ids") > 0).alias("o"), F.bool_or(F.col("there").isNotNull()).alias("c"))
    no, of = F.lit(False), scenarios.select("scenario_id").distinct().join(n, "scenario_id", "left")
    return of.select("scenario_id", F.col("n").isNotNull().alias("has_binding"), F.coalesce("n", F.lit(0)).alias("binding_count"), F.coalesce("o", no).alias("has_oracle"), F.coalesce("c", no).alias("has_cleanup"))


def action_steps(steps: DataFrame, sequence_ids: DataFrame) -> DataFrame:
    """(sequence_id, steps) in step order."""
    held = F.array_sort(F.collect_list(F.struct("step", "action_id")))
    return steps.join(sequence_ids, "sequence_id", "left_semi").groupBy("sequence_id").agg(F.transform(held, lambda x: x["action_id"]).alias("steps"))


def secret_references(leaves: DataFrame) -> DataFrame:
    """(record_id, references): values that name a stored secret, each once, sorted."""
    return leaves.filter(F.col("value").startswith("secret://")).groupBy("record_id").agg(F.array_sort(F.collect_set("value")).alias("references"))


def bundles(bindings: DataFrame, records: DataFrame) -> DataFrame:
    """(binding_id, refs): record ids of an approved binding by the type of the record, sorted. A reference to no record, or to one that is not approved, fails the job."""
    refs = _resolved(bindings, records)
    by_type = refs.groupBy("binding_id", "record_type").agg(F.array_sort(F.collect_set("record_id")).alias("ids"))
    return by_type.groupBy("binding_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_type", "ids")))).alias("refs"))


def bundle_provenance(bindings: DataFrame, records: DataFrame) -> DataFrame:
    """(binding_id, record_id, record_type, source_sheet, source_row, record_checksum): where each record of an approved binding's bundle comes from."""
    checksum = json_checksum(F.concat(F.lit('{"payload": '), F.coalesce("payload", F.lit("{}")), F.lit("}")))
    return _resolved(bindings, records).select("binding_id", "record_id", "record_type", "source_sheet", "source_row", checksum.alias("record_checksum")).distinct()


def _resolved(bindings: DataFrame, records: DataFrame) -> DataFrame:
    approved = bindings.filter(F.col("approval_status") == APPROVED)
    joined = references(approved).join(records.withColumn("_there", F.lit(True)), "record_id", "left")
    said = lambda what: F.concat(F.lit("binding '"), F.col("binding_id"), F.lit(f"' references {what} record '"), F.col("record_id"), F.lit("'"))
    sound = F.when(F.col("_there").isNull(), F.raise_error(said("unknown")).cast("boolean")).when(F.col("record_status") != APPROVED, F.raise_error(said("non-APPROVED")).cast("boolean")).otherwise(True)
    return joined.filter(sound).drop("_there")
