"""Queries over keyed tables: upserts, deletes, references, bindings, decisions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import canon, coverage as cov, readiness, store, testdata
from attestra.plans.registry import Registry, table
from attestra.sources.files import latest_per_key, tree_checksum

R = Registry()


def _carrier() -> Column:
    """A few names, dealt by supplier."""
    return F.when(F.col("l_suppkey") % 3 == 0, "AIR").when(F.col("l_suppkey") % 3 == 1, "SHIP").otherwise("RAIL")


@R.query("""
SELECT (SELECT count(*) FROM customer)::BIGINT AS n_requirements, (SELECT count(*) FROM orders)::BIGINT AS n_stories, (SELECT count(*) FROM lineitem)::BIGINT AS n_scenarios,
       (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))::BIGINT AS requirements_covered,
       (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))::BIGINT AS stories_covered""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return cov.coverage(
        t("customer").select(F.col("c_custkey").alias("requirement_id")), t("orders").select(F.col("o_custkey").alias("requirement_id"), F.col("o_orderkey").alias("story_id")), t("lineitem").select(F.col("l_orderkey").alias("story_id"))
    )


@R.query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of the whole stream into an empty table."""
    events = table(spark, sf_dir, "events")
    merged = store.upsert(events.limit(0), events, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return merged.select("user_id", "event_type", "event_id", "value")


@R.query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    new = base.filter("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("X"))
    return store.upsert(base, new, ["o_orderkey"]).drop("o_orderpriority")


@R.query("SELECT DISTINCT l_orderkey AS story_id, l_partkey AS chunk_id FROM lineitem")
def bridge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are offered twice, and stored once."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("chunk_id"))
    return store.insert_absent(store.insert_absent(rows.limit(0), rows, ["story_id", "chunk_id"]), rows, ["story_id", "chunk_id"])


@R.query("""
WITH old AS (SELECT c_custkey, (100001 + c_custkey * 2)::INT AS number FROM customer WHERE c_custkey % 5 = 0)
SELECT c_custkey, number FROM old
UNION ALL SELECT c_custkey, ((SELECT max(number) FROM old) + row_number() OVER (ORDER BY c_custkey))::INT FROM customer WHERE c_custkey % 5 <> 0""")
def case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth customer has a number already, with gaps between them; the others get the next ones.

    The numbers there are and those of the SQL have no bound but an int's: six digits, the
    operator's own bound, are used up by fewer than 450,000 customers.
    """
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    old = keys.filter("c_custkey % 5 = 0").withColumn("number", (F.col("c_custkey") * 2 + 100_001).cast("int"))
    return store.allocate_numbers(old, keys, "c_custkey", high=2**31 - 1)


@R.query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.delete_children(table(spark, sf_dir, "lineitem"), gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@R.query("SELECT l_returnflag, count(*)::BIGINT AS removed FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def reset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.removed_counts(rows, store.delete_children(rows, gone, ["l_orderkey"]), "l_returnflag")


@R.query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem)")
def orphan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    references = [lines.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), lines.select(F.col("l_suppkey").alias("p_partkey"))]
    return store.orphans(table(spark, sf_dir, "part"), references, "p_partkey").select("p_partkey")


@R.query("""
WITH o AS (SELECT DISTINCT o_custkey + 7 AS key FROM orders WHERE o_totalprice > 250000)
SELECT c_custkey AS key, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT key FROM o)
UNION ALL SELECT key, 'extra' FROM o WHERE key NOT IN (SELECT c_custkey FROM customer)""")
def id_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.set_differences(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select((F.col("o_custkey") + 7).alias("key")), "key")


@R.query("""
WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS binding, l_partkey AS p FROM lineitem),
     k AS (SELECT p_partkey AS p, CASE WHEN p_type = 'ECONOMY' THEN 'Fixture' ELSE p_type END AS kind, p_brand AS brand FROM part WHERE p_size > 10),
     i AS (SELECT 'REFERENCE_MISSING_FK' AS issue_code, binding AS record_id, 'binding `' || binding || '` references unknown record `' || p || '`' AS message FROM r WHERE p NOT IN (SELECT p FROM k)
           UNION ALL SELECT 'REFERENCE_WRONG_TYPE', binding, 'binding `' || binding || '` expects Fixture for `' || p || '` but found ' || kind FROM r JOIN k USING (p) WHERE kind <> 'Fixture'
           UNION ALL SELECT 'SEMANTIC_UNAPPROVED_RECORD', binding, 'binding `' || binding || '` references non-APPROVED `' || p || '`' FROM r JOIN k USING (p) WHERE kind = 'Fixture' AND brand < 'Brand#3')
SELECT issue_code, record_id, replace(message, '`', chr(39)) AS message FROM i""")
def reference_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line is a binding that names its part as its fixture."""
    lines = table(spark, sf_dir, "lineitem")
    bindings = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("binding_id"), F.col("l_partkey").cast("string").alias("fixture_id"))
    kind = F.when(F.col("p_type") == "ECONOMY", "Fixture").otherwise(F.col("p_type"))
    status = F.when(F.col("p_brand") < "Brand#3", "DRAFT").otherwise("APPROVED")
    records = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("record_id"), kind.alias("record_type"), status.alias("record_status"))
    return testdata.reference_issues(testdata.references(bindings), records).select("issue_code", "record_id", "message")


@R.query("""
WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'), m AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM c) AND l_quantity > 30),
     e AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM c) AND l_quantity <= 2)
SELECT p_partkey AS entity_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM m) OR p_partkey IN (SELECT l_partkey FROM e) OR p_partkey IN (SELECT l_suppkey FROM e)""")
def entities_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks, the urgent ones of a run that is reset; lines of many pieces mention their part, those of few link it to the supplier's number."""
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "chunk_id"})
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("run_id"))
    mentions = lines.filter("l_quantity > 30").select("chunk_id", F.col("l_partkey").alias("entity_id"))
    edges = lines.filter("l_quantity <= 2").select("chunk_id", F.col("l_partkey").alias("source_entity_id"), F.col("l_suppkey").alias("target_entity_id"))
    return store.reset_run(chunks, mentions, edges, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id")), "1-URGENT")["entities"]


@R.query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT l_orderkey, l_linenumber + 100, l_partkey FROM lineitem WHERE l_quantity > 40 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of open orders are deleted; those of many pieces come again under other numbers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    new = lines.filter("l_quantity > 40").withColumn("l_linenumber", F.col("l_linenumber") + 100)
    parents = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.replace_children(lines, new, parents, ["l_orderkey"]).drop("l_quantity")


@R.query("SELECT o_orderkey AS tc_id, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 3 = 0)")
def accepted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, finished ones accepted; lines by air as the cases of a run."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tc_id"), "o_custkey", F.when(F.col("o_orderstatus") == "F", "ACCEPTED").otherwise("OPEN").alias("status"))
    runs = table(spark, sf_dir, "lineitem").select(F.lit("p").alias("project"), _carrier().alias("run_id"), F.col("l_orderkey").alias("tc_id"))
    return store.accepted_cases(cases, runs, "p", "AIR").drop("status")


@R.query("SELECT p_partkey AS entity_id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 100 = 0) AS mentioned FROM part")
def mentioned_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 100 == 0, "c").otherwise("d").alias("chunk_id"), F.col("l_partkey").alias("entity_id"))
    return store.mentioned_entities(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id")), mentions, "c")


@R.query("SELECT l_orderkey AS sequence_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def action_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sequence_id"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("action_id"))
    wanted = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("sequence_id"))
    return testdata.action_steps(steps, wanted).select("sequence_id", F.array_join("steps", ",").alias("steps"))


@R.query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_custkey % 3 + 1 >= 2)")
def rows_after_stage_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, priority and key stand for project, run and stage; the second stage is reset, and the third with it."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("project"), F.col("o_orderpriority").alias("run_id"), (F.col("o_custkey") % 3 + 1).alias("stage"))
    return store.cascade_stages(rows, "O", "1-URGENT", 2).select("o_orderkey", "o_custkey")


@R.query("SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


@R.query("SELECT event_id, n::INT AS occurrence FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 1")
def later_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.later_occurrences(table(spark, sf_dir, "events"), "user_id", ["event_id"]).select("event_id", "occurrence")


_BINDINGS = """
WITH b AS (SELECT l_partkey AS s, l_orderkey || '-' || l_linenumber AS b, CASE l_suppkey % 3 WHEN 0 THEN 'AIR' WHEN 1 THEN 'SHIP' ELSE 'RAIL' END AS profile, CASE WHEN l_linestatus = 'F' THEN 'default' ELSE l_linestatus END AS v, l_quantity::INT // 10 AS p, l_discount AS d, l_tax AS t,
                  CASE WHEN l_tax > 0.05 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'c' ELSE 'gone' END END AS cleanup FROM lineitem WHERE l_returnflag <> 'R')"""


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as bindings of their part: the carrier is the profile; the variant is null, the default one, or the line's status."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("scenario_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("binding_id"), F.floor(F.col("l_quantity") / 10).cast("int").alias("selection_priority"),
        F.when(F.col("l_returnflag") == "R", "REJECTED").otherwise("APPROVED").alias("approval_status"), F.when(F.col("l_discount") > 0.08, F.array(F.lit("o"))).otherwise(F.array().cast("array<string>")).alias("oracle_ids"),
        F.when(F.col("l_tax") > 0.05, F.when(F.col("l_suppkey") % 2 == 0, "c").otherwise("gone")).alias("cleanup_id"), F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("variant_id"), _carrier().alias("execution_profile_id"),
    )


@R.query(_BINDINGS + """,
     a AS (SELECT p_partkey AS s, profile, v FROM part, (SELECT unnest(['AIR', 'SHIP']) AS profile), (SELECT unnest(['default', 'O']) AS v)),
     m AS (SELECT s, profile, v, max(p) AS p FROM b GROUP BY ALL),
     g AS (SELECT s, profile, v, count(*) AS n, list_sort(list(b)) AS ids FROM b JOIN m USING (s, profile, v, p) GROUP BY ALL)
SELECT s AS scenario_id, profile AS execution_profile_id, v AS variant_id, CASE WHEN n IS NULL THEN 'BLOCKED_MISSING_DATA' WHEN n = 1 THEN 'READY' ELSE 'BLOCKED_AMBIGUOUS_BINDING' END AS status,
       CASE WHEN n = 1 THEN ids[1] END AS binding_id, CASE WHEN n > 1 THEN array_to_string(ids, ',') ELSE '' END AS candidates FROM a LEFT JOIN g USING (s, profile, v)""")
def resolved_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with two profiles and two variants."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scenario_id"), F.explode(F.array(F.lit("AIR"), F.lit("SHIP"))).alias("execution_profile_id"))
    asked = asked.select("*", F.explode(F.array(F.lit(None).cast("string"), F.lit("O"))).alias("variant_id"))
    return testdata.resolve_bindings(asked, _bindings(spark, sf_dir)).withColumn("candidates", F.array_join("candidates", ","))


@R.query(_BINDINGS + """,
     w AS (SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS k, bool_and(l_returnflag <> 'R' AND l_suppkey % 3 = 0 AND l_linestatus = 'F') AS fits FROM lineitem GROUP BY 1),
     n AS (SELECT p_partkey AS s, min(l_orderkey || '-' || l_linenumber) AS id FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)
SELECT s AS scenario_id, id AS binding_id, CASE WHEN k <> 1 THEN 'unavailable' WHEN fits THEN 'READY' ELSE 'does_not_match' END AS status FROM n JOIN w USING (id)""")
def selected_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings named beforehand, whatever their profile, variant and state."""
    bindings = _bindings(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scenario_id"))
    named = bindings.groupBy("scenario_id").agg(F.min("binding_id").alias("binding_id")).join(parts, "scenario_id", "left_semi")
    asked = named.select("scenario_id", F.lit("AIR").alias("execution_profile_id"), F.lit(None).cast("string").alias("variant_id"), "binding_id")
    return testdata.select_binding(asked, bindings).select("scenario_id", "binding_id", "status")


@R.query(_BINDINGS + """
SELECT p_partkey AS scenario_id, count(b) > 0 AS has_binding, count(b)::BIGINT AS binding_count, coalesce(bool_or(d > 0.08), false) AS has_oracle, coalesce(bool_or(coalesce(cleanup, '') = 'c'), false) AS has_cleanup
FROM part LEFT JOIN b ON s = p_partkey GROUP BY 1""")
def binding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.createDataFrame([("c",)], "record_id string")
    return testdata.binding_coverage(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scenario_id")), _bindings(spark, sf_dir), records)


@R.query(_BINDINGS + """,
     g AS (SELECT s, list_sort(list(DISTINCT v)) AS l FROM b WHERE profile = 'AIR' GROUP BY s),
     e AS (SELECT p_partkey AS s, 'O' AS named FROM part WHERE p_size > 40)
SELECT p_partkey AS scenario_id, CASE WHEN named IS NOT NULL THEN CASE WHEN list_contains(l, named) THEN named END WHEN len(l) = 1 THEN l[1] END AS variant_id,
       CASE WHEN named IS NOT NULL THEN CASE WHEN coalesce(list_contains(l, named), false) THEN 'selected' ELSE 'unknown_variant' END WHEN len(l) = 1 THEN 'selected' WHEN len(l) > 1 THEN 'several' ELSE 'none' END AS status
FROM part LEFT JOIN g ON g.s = p_partkey LEFT JOIN e ON e.s = p_partkey""")
def selected_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scenario_id"), "p_size")
    return testdata.select_variant(_bindings(spark, sf_dir), "AIR", parts, parts.filter("p_size > 40").select("scenario_id", F.lit("O").alias("variant_id")))


@R.query("""
WITH c AS (SELECT l_suppkey AS s, l_partkey AS c, l_returnflag AS f, l_orderkey || '-' || l_linenumber AS fqn, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS pos FROM lineitem WHERE l_quantity > 20),
     g AS (SELECT s, c, min_by(fqn, pos) FILTER (WHERE f = 'A') AS e, min_by(fqn, pos) FILTER (WHERE f = 'N') AS p, min_by(fqn, pos) FILTER (WHERE f = 'R') AS w, count(*) FILTER (WHERE f = 'N') AS n FROM c GROUP BY ALL),
     a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS c, p_size > 25 AS may FROM lineitem JOIN part ON p_partkey = l_partkey),
     d AS (SELECT a.s, a.c, e, p, w, CASE WHEN e IS NOT NULL THEN 'reuse' WHEN n >= 2 THEN 'compose' WHEN w IS NOT NULL THEN 'wrap' WHEN may THEN 'implement' END AS decision FROM a LEFT JOIN g ON a.s = g.s AND a.c = g.c)
SELECT s AS scenario_id, c AS capability_id, decision, CASE decision WHEN 'reuse' THEN e WHEN 'compose' THEN p WHEN 'wrap' THEN w END AS selected, CASE WHEN decision IS NULL THEN 'BLOCKED_MISSING_CAPABILITY' END AS blocker FROM d""")
def capability_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of more than 20 pieces are candidates of their supplier and part; other pairs have none."""
    kind = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "partial").otherwise("compatible")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scenario_id"), F.col("l_partkey").alias("capability_id"), F.struct("l_orderkey", "l_linenumber").alias("pos"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fqn"), kind.alias("match_kind"), "l_quantity")
    may = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("capability_id"), (F.col("p_size") > 25).alias("authorized"))
    asked = lines.select("scenario_id", "capability_id").distinct().join(may, "capability_id")
    return readiness.decide_capability(asked, lines.filter("l_quantity > 20"))


_GATES = {
    "framework_snapshot_ready": "o_orderkey % 29 <> 0", "bundle_available": "o_totalprice > 5000", "oracles_present": "o_orderpriority <> '5-LOW'", "all_actions_mapped": "o_orderstatus <> 'P'",
    "framework_modifications_authorized": "o_custkey % 2 = 0", "worktree_matches_index": "o_orderkey % 7 <> 0", "traceability_valid": "o_custkey % 5 <> 0",
}
_GATE_STATUS = {
    "framework_snapshot_ready": "BLOCKED_FRAMEWORK_STALE", "bundle_available": "BLOCKED_MISSING_DATA", "oracles_present": "BLOCKED_MISSING_DATA", "all_actions_mapped": "BLOCKED_MISSING_CAPABILITY",
    "framework_modifications_authorized": "BLOCKED_AUTHORIZATION", "worktree_matches_index": "BLOCKED_FRAMEWORK_STALE", "traceability_valid": "BLOCKED_MISSING_DATA",
}
_GATE_SQL = {k: f"({v}) OR o_orderkey % 3 <> 0" if k == "framework_modifications_authorized" else v for k, v in _GATES.items()}


@R.query(f"""
WITH b AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'BLOCKED_MISSING_DATA' WHEN '2-HIGH' THEN 'NOT_APPLICABLE' ELSE 'READY' END AS binding FROM orders)
SELECT o_orderkey, CASE WHEN binding NOT IN ('READY', 'NOT_APPLICABLE') THEN binding {' '.join(f"WHEN NOT ({v}) THEN '{_GATE_STATUS[k]}'" for k, v in _GATE_SQL.items())} ELSE 'READY' END AS readiness,
       CASE WHEN binding NOT IN ('READY', 'NOT_APPLICABLE') THEN 'scenario_data_binding' {' '.join(f"WHEN NOT ({v}) THEN '{k}'" for k, v in _GATE_SQL.items())} END AS failed_check FROM b""")
def readiness_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framework modification is required of every third order."""
    binding = F.when(F.col("o_orderpriority") == "1-URGENT", "BLOCKED_MISSING_DATA").when(F.col("o_orderpriority") == "2-HIGH", "NOT_APPLICABLE").otherwise("READY")
    met = (F.expr(_GATES[g] if g in _GATES else "true").alias(g) for g in readiness.GATES)
    gates = table(spark, sf_dir, "orders").select("o_orderkey", binding.alias("binding_status"), (F.col("o_orderkey") % 3 == 0).alias("framework_modification_required"), *met)
    return readiness.readiness(gates).select("o_orderkey", "readiness", "failed_check")


@R.query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_totalprice < 50000 OR o_orderstatus = 'P' THEN 'SPEC_DATA_MISSING' WHEN o_orderpriority IN ('5-LOW', '3-MEDIUM') THEN 'CAPABILITY_MISSING' ELSE 'SUFFICIENT' END AS status,
       CASE WHEN o_orderkey % 11 = 0 OR o_totalprice < 50000 OR o_orderstatus = 'P'
            THEN concat_ws('|', CASE WHEN o_orderkey % 11 = 0 THEN 'worktree hashes do not match the indexed snapshot; reindex required' END, CASE WHEN o_totalprice < 50000 THEN 'resolved test-data bundle is not available' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END)
            WHEN o_orderpriority = '5-LOW' THEN 'capability ' || chr(39) || '5-LOW' || chr(39) || ' is unmapped' WHEN o_orderpriority = '3-MEDIUM' THEN 'one or more scenario actions have no mapped capability' ELSE '' END AS reasons FROM orders""")
def context_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("o_orderpriority") == "5-LOW"
    found = readiness.sufficiency(
        F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") >= 50000, F.array_compact(F.array(F.when(F.col("o_orderstatus") == "P", F.lit("status")))),
        ~(low | (F.col("o_orderpriority") == "3-MEDIUM")), F.array_compact(F.array(F.when(low, F.col("o_orderpriority")))),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", found["status"].alias("status"), F.array_join(found["reasons"], "|").alias("reasons"))


@R.query("SELECT o_custkey AS run_id, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'COMPLETED' ELSE 'PARTIAL_FAILED' END AS run_status FROM orders GROUP BY 1")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.run_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "ACCEPTED").otherwise("OPEN").alias("status")))


@R.query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n, CASE WHEN count(o_orderkey) = 0 THEN 'no_story' ELSE 'generated' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def story_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.progress(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "no_story")


@R.query("""
SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY k) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1""")
def ordered_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(canon.ordered_union(F.col("o_orderkey"), F.array("o_orderpriority")), ",").alias("priorities"))


@R.query("""
SELECT event_type AS key, arg_max(event_id, event_id) AS event_id, min(event_id) AS position FROM events GROUP BY 1""")
def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all runs the last value of a key, at its first position."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id", F.col("event_id").alias("position"))
    return latest_per_key(rows, "key", F.col("event_id"), "position").select("key", "event_id", "position")


@R.query("""
SELECT s_nationkey, 'sha256:' || sha256(string_agg(s_name || chr(0) || sha256(s_name) || chr(10), '' ORDER BY s_name)) AS tree_checksum FROM supplier GROUP BY 1""")
def tree_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("relative_path"), F.sha2("s_name", 256).alias("digest"))
    return tree_checksum(entries, ("s_nationkey",))


@R.query("""
SELECT o_custkey AS snapshot_group, o_orderkey AS snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1""")
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("snapshot_group"), F.col("o_orderkey").alias("snapshot_id"), (F.col("o_orderpriority") == "1-URGENT").alias("active"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("building").alias("status"))
    return readiness.latest_snapshot(rows, ["snapshot_group"]).select("snapshot_group", "snapshot_id")
