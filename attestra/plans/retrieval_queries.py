"""Queries over vectors, evidence, budgets and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.json_text import explode_leaves
from attestra.operators import context, graph, retrieval
from attestra.plans.registry import Registry, table
from attestra.ports import lexical_score

R = Registry()
K = 12

_TOP_K = """
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
     d AS (SELECT query_id, vec_id, list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) FOR x IN list_zip(embedding, q)]) AS distance FROM q, embeddings {where}),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, rank::INT AS rank, round(distance, 6) AS distance, round(1 / (1 + greatest(distance, 0)), 6) AS score FROM r WHERE rank <= 12"""


def _top_k(spark: SparkSession, sf_dir: str, allowed_labels: tuple[int, ...] | None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    allowed = vectors.filter(F.col("label").isin(*allowed_labels)).select("vec_id") if allowed_labels else None
    found = retrieval.vector_top_k(queries, vectors.select("vec_id", "embedding"), K, allowed)
    return found.select("query_id", "vec_id", F.col("rank"), F.round("distance", 6).alias("distance"), F.round(retrieval.similarity_score(F.col("distance")), 6).alias("score"))


@R.query(_TOP_K.format(where=""))
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    return _top_k(spark, sf_dir, None)


@R.query(_TOP_K.format(where="WHERE label IN (1, 3, 5, 7)"))
def vector_top_k_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_k(spark, sf_dir, (1, 3, 5, 7))


@R.query("SELECT count(*)::BIGINT AS n, count(DISTINCT len(embedding))::BIGINT AS dimensions, 1::BIGINT AS fingerprints, true AS finite FROM embeddings")
def embedding_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.embedding_contract(table(spark, sf_dir, "embeddings"))


_EVIDENCE = """
WITH e AS (
  SELECT o_custkey AS anchor, o_orderkey AS chunk_id, o_orderkey AS pos, 1.0::DOUBLE AS score, 'authoritative' AS source, 0 AS priority FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_custkey, o_orderkey, o_orderkey, 0.5::DOUBLE, 'graph', 1 FROM orders WHERE o_totalprice > 150000
  UNION ALL SELECT o_custkey, o_orderkey, o_orderkey, round(o_totalprice / 1000000, 6), 'vector', 2 FROM orders WHERE o_orderstatus = 'O'),
     f AS (SELECT *, row_number() OVER (PARTITION BY anchor, chunk_id ORDER BY priority, pos) AS first FROM e),
     m AS (SELECT * FROM f WHERE first = 1)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    of = lambda rows, score: rows.select(F.col("o_custkey").alias("anchor"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("pos"), score.alias("score"))
    return retrieval.merge_evidence({
        "authoritative": of(orders.filter("o_orderpriority = '1-URGENT'"), F.lit(1.0)), "graph": of(orders.filter("o_totalprice > 150000"), F.lit(0.5)),
        "vector": of(orders.filter("o_orderstatus = 'O'"), F.round(F.col("o_totalprice") / 1000000, 6)),
    })


@R.query(_EVIDENCE + " SELECT anchor, chunk_id, source, score FROM m")
def hybrid_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("anchor", "chunk_id", "source", "score")


@R.query(_EVIDENCE + """,
 r AS (SELECT *, row_number() OVER (PARTITION BY anchor, priority > 0 ORDER BY score DESC, priority, pos) AS place FROM m),
 k AS (SELECT * FROM r WHERE priority = 0 OR place <= 6)
SELECT anchor, chunk_id, source, row_number() OVER (PARTITION BY anchor ORDER BY priority > 0, CASE WHEN priority > 0 THEN place ELSE pos END)::INT AS rank FROM k""")
def reranked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(_evidence(spark, sf_dir), F.col("score"), 6).select("anchor", "chunk_id", "source", "rank")


_BUDGET = """
WITH RECURSIVE i AS (SELECT o_custkey AS anchor, o_orderkey AS item, ceil(o_totalprice / 1000)::BIGINT AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
     f AS (SELECT anchor, item, n, cost AS spent, true AS kept FROM i WHERE n = 1
           UNION ALL SELECT i.anchor, i.item, i.n, f.spent + CASE WHEN f.spent + i.cost <= 600 THEN i.cost ELSE 0 END, f.spent + i.cost <= 600 FROM f JOIN i ON i.anchor = f.anchor AND i.n = f.n + 1)
SELECT anchor, item FROM f WHERE kept"""


@R.query(_BUDGET)
def evidence_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in order; one that does not fit is skipped, the first always stays."""
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("anchor"), F.col("o_orderkey").alias("item"), "o_totalprice")
    return retrieval.within_budget(items, "anchor", ["item"], F.ceil(F.col("o_totalprice") / 1000), 600).select("anchor", "item")


@R.query("""
WITH RECURSIVE i AS (SELECT o_custkey AS anchor, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END AS tier, o_orderkey AS pos, greatest(1, length(o_orderpriority || o_orderstatus) // 4)::BIGINT AS cost FROM orders),
     o AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY tier, pos) AS n FROM i),
     f AS (SELECT anchor, tier, pos, n, CASE WHEN tier = 0 THEN 0 WHEN cost <= 8 THEN cost ELSE 0 END AS spent, tier = 0 OR cost <= 8 AS kept FROM o WHERE n = 1
           UNION ALL SELECT o.anchor, o.tier, o.pos, o.n, f.spent + CASE WHEN o.tier <> 0 AND f.spent + o.cost <= 8 THEN o.cost ELSE 0 END, o.tier = 0 OR f.spent + o.cost <= 8 FROM f JOIN o ON o.anchor = f.anchor AND o.n = f.n + 1)
SELECT anchor, tier::INT AS tier, pos FROM f WHERE kept""")
def context_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("anchor"), tier.alias("tier"), F.col("o_orderkey").alias("pos"), F.concat("o_orderpriority", "o_orderstatus").alias("text"))
    return context.assemble_manifest(items, 8).select("anchor", "tier", "pos")


@R.query(r"""
SELECT p_partkey, round((list_contains(w, 'gold')::INT + list_contains(w, 'widget')::INT) / 2.0, 6) AS score FROM (SELECT p_partkey, regexp_split_to_array(lower(p_name), '\W+') AS w FROM part)""")
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(lexical_score(F.lit("gold widget"), F.col("p_name")), 6).alias("score"))


_GRAPH = """
WITH e AS (SELECT 'sn' || s_suppkey AS edge_id, 's' || s_suppkey AS a, 'n' || s_nationkey AS b, false AS allowed FROM supplier
           UNION ALL SELECT 'nr' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey, true FROM nation)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    up = s.select(name("sn", "s_suppkey").alias("edge_id"), name("s", "s_suppkey").alias("source"), name("n", "s_nationkey").alias("target"), F.lit(False).alias("allowed"), F.lit("IN").alias("relation"))
    out = up.unionByName(n.select(name("nr", "n_nationkey").alias("edge_id"), name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"), F.lit(True).alias("allowed"), F.lit("OF").alias("relation")))
    return out.withColumn("chunk_id", F.col("edge_id")).withColumn("sequence_index", F.substring("edge_id", 3, 9).cast("int") % 5)


@R.query(_GRAPH + """,
 u AS (SELECT edge_id, a, b, allowed FROM e UNION ALL SELECT edge_id, b, a, allowed FROM e),
 p AS (SELECT x.a AS anchor, x.edge_id AS e1, x.allowed AS l1, y.edge_id AS e2, y.allowed AS l2, z.edge_id AS e3, z.allowed AS l3
       FROM u x LEFT JOIN u y ON y.a = x.b AND y.edge_id <> x.edge_id LEFT JOIN u z ON z.a = y.b AND z.edge_id <> x.edge_id AND z.edge_id <> y.edge_id WHERE x.a LIKE 's%'),
 c AS (SELECT anchor, e1 AS c FROM p WHERE l1 UNION SELECT anchor, e2 FROM p WHERE l2 UNION SELECT anchor, e3 FROM p WHERE l3),
 r AS (SELECT anchor, c, row_number() OVER (PARTITION BY anchor ORDER BY substr(c, 3)::INT % 5, c) AS pos FROM c)
SELECT anchor, c AS chunk_id, round(1.0 / 3, 6)::DOUBLE AS score, pos::INT AS pos FROM r WHERE pos <= 2""")
def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("anchor")).withColumn("node", F.col("anchor"))
    return graph.graph_evidence(starts, _edges(spark, sf_dir), 3, 2).select("anchor", "chunk_id", F.round("score", 6).alias("score"), "pos")


@R.query(_GRAPH + """
SELECT s.a AS seed, s.b AS node, 1 AS depth FROM e s UNION SELECT s.a, t.b, 2 FROM e s JOIN e t ON s.b = t.a""")
def directed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.neighbours(edges.select(F.col("source").alias("seed")).distinct(), edges, 4)


@R.query(_GRAPH + """
SELECT a AS seed, b AS node, string_agg(DISTINCT CASE WHEN edge_id LIKE 'sn%' THEN 'IN' ELSE 'OF' END, ',') AS relations FROM e GROUP BY 1, 2""")
def neighbours_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    found = graph.merged_neighbours(edges.select(F.col("source").alias("seed")).distinct(), edges, ("IN", "OF"), 80)
    return found.select("seed", "node", F.array_join("relations", ",").alias("relations"))


@R.query("""
WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
     c AS (SELECT 's' || s_suppkey AS root, 's' || s_suppkey AS record_id, 0 AS round FROM supplier UNION ALL SELECT root, b, round + 1 FROM c JOIN e ON a = record_id)
SELECT root, record_id, min(round)::INT AS round FROM c GROUP BY root, record_id""")
def reference_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers name their nation, and nations their regions, in payloads; other fields name nothing."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    of = lambda df, key, prefix, payload: df.select(name(prefix, key).alias("record_id"), F.to_json(payload).alias("payload"))
    records = of(s, "s_suppkey", "s", F.struct(name("n", "s_nationkey").alias("nation_id"), name("r", "s_suppkey").alias("note"))).unionByName(
        of(n, "n_nationkey", "n", F.struct(F.array(name("r", "n_regionkey"), F.lit("none")).alias("region_ids")))).unionByName(of(r, "r_regionkey", "r", F.struct(F.lit("s1").alias("ids_of"))))
    roots = s.select(name("s", "s_suppkey").alias("root"), name("s", "s_suppkey").alias("record_id"))
    return graph.closure_by_key(records, roots, explode_leaves(records, "payload"))


@R.query("""
WITH RECURSIVE c AS (SELECT s_suppkey AS root, s_suppkey AS record_id, 0 AS round FROM supplier UNION ALL SELECT root, record_id - 9, round + 1 FROM c WHERE record_id - 9 IN (SELECT s_suppkey FROM supplier) AND record_id % 50 <> 0)
SELECT 's' || root AS root, 's' || record_id AS record_id, round::INT AS round FROM c""")
def value_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of many links: a supplier names the one nine before it somewhere in its payload, every fiftieth none."""
    key = F.col("s_suppkey")
    named = F.when(key % 50 != 0, F.concat(F.lit("s"), (key - 9).cast("string")))
    records = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key.cast("string")).alias("record_id"), F.to_json(F.struct(F.struct(F.array(F.lit("x"), named).alias("b")).alias("a"))).alias("payload"))
    return graph.closure_by_value(records, records.select(F.col("record_id").alias("root"), "record_id"), explode_leaves(records, "payload"))


@R.query("""
WITH l AS (SELECT l_orderkey AS s, l_partkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos FROM lineitem)
SELECT s AS story_id, pos::INT AS pos, r AS requirement_id, p_name AS name FROM l JOIN part ON p_partkey = r""")
def story_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stories of the parts of their lines."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("requirement_id"), F.col("p_name").alias("name"))
    return retrieval.story_requirements(_stories(spark, sf_dir), parts).select("story_id", "pos", "requirement_id", "name")


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    return lines.select(F.col("l_orderkey").alias("story_id"), F.transform("l", lambda x: x["l_partkey"]).alias("requirement_ids"))


@R.query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem),
     l AS (SELECT o_custkey AS c, l_partkey AS r, min(o_orderkey * 1000 + pos) AS place FROM orders JOIN n ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT c AS scenario_id, string_agg(r::VARCHAR, ',' ORDER BY place) AS requirement_ids FROM l GROUP BY c""")
def scenario_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scenarios of their orders, in the order of their keys."""
    stories = _stories(spark, sf_dir)
    own = table(spark, sf_dir, "orders").join(stories, F.col("o_orderkey") == F.col("story_id"), "left_semi")
    scenarios = own.groupBy(F.col("o_custkey").alias("scenario_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("story_ids"))
    found = retrieval.scenario_lineage(scenarios, stories, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("requirement_id")))
    return found.select("scenario_id", F.array_join("requirement_ids", ",").alias("requirement_ids"))


@R.query("""
WITH RECURSIVE i AS (SELECT o_custkey AS anchor, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END AS tier, CASE WHEN o_orderstatus = 'F' THEN 'evidence_chunks' ELSE 'matched_symbols' END AS grp,
                            o_orderkey AS k, greatest(1, ceil(length(o_orderpriority || o_orderstatus) / 4.0))::BIGINT AS cost FROM orders),
     o AS (SELECT *, grp <> 'evidence_chunks' AS sym, row_number() OVER (PARTITION BY anchor ORDER BY tier, grp, k) AS n FROM i),
     f AS (SELECT anchor, k, n, grp, CASE WHEN cost <= 9 THEN cost ELSE 0 END AS spent, (cost <= 9 AND sym)::INT AS syms, cost <= 9 AS kept FROM o WHERE n = 1
           UNION ALL SELECT o.anchor, o.k, o.n, o.grp, f.spent + CASE WHEN ok THEN o.cost ELSE 0 END, f.syms + (ok AND o.sym)::INT, ok
                     FROM f JOIN o ON o.anchor = f.anchor AND o.n = f.n + 1, LATERAL (SELECT f.spent + o.cost <= 9 AND (NOT o.sym OR f.syms < 2) AS ok))
SELECT anchor, grp AS "group", count(*)::BIGINT AS dropped FROM f WHERE NOT kept GROUP BY ALL""")
def dropped_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a budget of 9 and a cap of two symbols leave out; evidence is no symbol."""
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    group = F.when(F.col("o_orderstatus") == "F", "evidence_chunks").otherwise("matched_symbols")
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("anchor"), tier.alias("tier"), group.alias("group"), F.col("o_orderkey").alias("key"), F.concat("o_orderpriority", "o_orderstatus").alias("json"))
    return context.dropped_counts(context.apply_budget(items, 9, 2))


@R.query("""
SELECT 'o' || o_custkey AS chunk_id, max(o_totalprice) AS score, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sources, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS targets, count(DISTINCT o_orderkey)::BIGINT AS n_edges
FROM orders GROUP BY o_custkey""")
def evidence_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("chunk_id"), F.col("o_totalprice").alias("confidence"), F.concat(F.lit("p"), "o_orderpriority").alias("source"), F.concat(F.lit("t"), "o_orderstatus").alias("target"), F.col("o_orderkey").alias("edge_id"))
    found = graph.evidence_summary(rows)
    pick = lambda prefix: F.array_join(F.transform(F.filter("entity_ids", lambda x: x.startswith(prefix)), lambda x: F.regexp_replace(x, "^.", "")), ",")
    return found.select("chunk_id", "score", pick("p").alias("sources"), pick("t").alias("targets"), F.size("edge_ids").cast("long").alias("n_edges"))


@R.query("""
WITH t AS (SELECT r_regionkey AS anchor, unnest(['gold', 'widget', 'steel', 'cold']) AS term FROM region),
     h AS (SELECT anchor, p_partkey, p_name, count(DISTINCT term) AS n FROM t, part WHERE contains(lower(p_name), term) GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, lower(p_name), p_partkey::VARCHAR) AS rank FROM h)
SELECT anchor, p_partkey::VARCHAR AS symbol_id, n::BIGINT AS n_terms, rank::INT AS rank FROM r WHERE rank <= 20""")
def symbols_by_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("anchor"), F.explode(F.array(*(F.lit(x) for x in ("gold", "widget", "steel", "cold")))).alias("term"))
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol_id"), F.col("p_name").alias("fqn"))
    return context.symbol_matches(terms, symbols, 20).select("anchor", "symbol_id", "n_terms", "rank")


@R.query("SELECT p_partkey::VARCHAR AS symbol_id, p_name AS fqn FROM part WHERE contains(lower(p_name), 'widget') AND p_type IN ('ECONOMY', 'STANDARD') ORDER BY p_name, p_partkey::VARCHAR LIMIT 20")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol_id"), F.col("p_name").alias("fqn"), F.col("p_type").alias("kind"))
    return context.search_symbols(symbols, "Widget", ("ECONOMY", "STANDARD"), 20).select("symbol_id", "fqn")
