"""Queries of pages, extractions, searches, versions and projections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import ids, text
from attestra.operators import canon, discovery, graph, projection, pruning, readiness, store, vector_index
from attestra.operators.commits import Table
from attestra.plans.registry import Registry, table
from attestra.sources import pages, workbook

R = Registry()

#: Order lines whose words a task holds and sorts, about: some 700,000 words.
LINES_OF_TASK = 100_000


def _scratch(spark: SparkSession) -> str:
    return f"{graph.shared_folder(spark)}/attestra-{uuid.uuid4().hex}"


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order) - 1)


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem"


def _word(x: float, y: Column | float, text: Column | str) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), (y if isinstance(y, Column) else F.lit(y)).cast("double").alias("y0"), (text if isinstance(text, Column) else F.lit(text)).cast("string").alias("word"))


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, their orders as pages: a note, a heading, a table of the order's lines (every other id is parted), a footer, a page number.

    Orders with their lines are dealt by document before they become words, which are many
    times as much; so partitions are not joined by their size, and there are as many as
    leave a task ``LINES_OF_TASK`` lines or fewer on average.
    """
    of_order = F.collect_list(F.struct("n", "l_partkey")).alias("held")
    lines = _numbered_lines(spark, sf_dir).groupBy("l_orderkey").agg(of_order)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // LINES_OF_TASK))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_key"), "o_orderkey", "o_orderstatus")
    dealt = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").repartition(n_parts, "doc_key")
    pages_of = dealt.withColumn("page", F.row_number().over(Window.partitionBy("doc_key").orderBy("o_orderkey")))
    fixed = F.array(
        _word(40, 60, "Note"), _word(70, 60, "for"), _word(100, 60, F.col("o_orderstatus")), _word(40, 80, "1"), _word(60, 80, "Order"), _word(100, 80, F.col("o_orderkey")),
        _word(40, 100, "ID"), _word(120, 100, "Requirement"), _word(300, 780, "Draft "), _word(330, 780.5, "copy"), _word(40, 795, F.col("page")), _word(50, 795, "/"), _word(60, 795, "9"),
    )

    def of_line(line: Column) -> Column:
        y, digits = 112 + line["n"] * 20, F.lpad(line["n"].cast("string"), 3, "0")
        plain = F.array(_word(40, y, F.concat(F.lit("BR-"), digits)), _word(120, y, "part"), _word(150, y, line["l_partkey"]))
        parted = F.array(_word(40, y, "BR-"), _word(120, y, "part"), _word(150, y, line["l_partkey"]), _word(40, y + 9, digits), _word(120, y + 9, "more"))
        return F.when(line["n"] % 2 == 0, plain).otherwise(parted)

    of_lines = F.flatten(F.transform(F.coalesce("held", F.array()), of_line))
    words = pages_of.select("doc_key", "page", F.explode(F.concat(fixed, of_lines)).alias("w"))
    return words.select("doc_key", "page", F.lit(842.0).alias("page_height"), "w.x", "w.y0", (F.col("w.y0") + 8).alias("y1"), "w.word")


@R.query("""
WITH o AS (SELECT o_custkey AS d, o_orderkey AS k, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, count(*) OVER (PARTITION BY o_custkey) AS pages FROM orders),
     l AS (SELECT l_orderkey AS k, l_partkey AS p, n, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM (""" + _NUMBERED + """)),
     i AS (SELECT d, page, 0 AS item, 'paragraph' AS kind, 'Note for ' || st AS text FROM o UNION ALL SELECT d, page, 1, 'heading', '1 Order ' || k FROM o
           UNION ALL SELECT d, page, 2 + n, 'table_row', 'BR-' || lpad(n::VARCHAR, 3, '0') || ' part ' || p || CASE WHEN n % 2 = 1 THEN ' more' ELSE '' END || CASE WHEN pages = 1 AND n = lines - 1 THEN ' Draft copy' ELSE '' END FROM o JOIN l USING (k)
           UNION ALL SELECT d, page, 2, 'paragraph', 'Draft copy' FROM o WHERE pages = 1 AND k NOT IN (SELECT k FROM l)),
     w AS (SELECT *, (sum(length(text) + 2) OVER z - 2)::INT AS e, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER z AS section, sum((kind = 'table_row')::INT) OVER z AS n FROM i WINDOW z AS (PARTITION BY d ORDER BY page, item ROWS UNBOUNDED PRECEDING))
SELECT d::VARCHAR AS doc_key, (row_number() OVER (PARTITION BY d ORDER BY page, item) - 1)::INT AS pos, text, (e - length(text))::INT AS start, e AS "end", kind, section,
       'page=' || page || CASE kind WHEN 'heading' THEN ',section=' || text WHEN 'table_row' THEN ',section=' || coalesce(section, '') || ',row=' || n ELSE '' END AS location FROM w""")
def page_table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages.without_page_noise(pages.page_lines(_page_words(spark, sf_dir)))
    return pages.page_blocks(lines).select("doc_key", "pos", "text", "start", "end", "kind", "section", "location")


def _extraction(spark: SparkSession, sf_dir: str) -> pruning.Extraction:
    """Orders as chunks: their lines as relationships of parts and suppliers, large parts named by the order's one requirement.

    Lines are joined and dealt by order once, and written; what they are told as needs no further shuffle.
    """
    lines = _numbered_lines(spark, sf_dir).select("l_orderkey", "n", "l_partkey", "l_suppkey")
    lines = lines.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    lines = lines.select("l_orderkey", "n", "l_partkey", "l_suppkey", "p_name", "p_size", "s_name", "s_suppkey").repartition("l_orderkey")
    lines = graph.written(lines)
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    rows = lines.select(F.col("l_orderkey").alias("chunk_id"), "n", name("p", "l_partkey").alias("part"), name("s", "l_suppkey").alias("supplier"), name("k", "n").alias("relationship_ref"), "p_name", "s_name", "s_suppkey", "p_size")
    aliases = F.array().cast("array<string>").alias("aliases")
    parts = rows.select("chunk_id", F.col("part").alias("entity_ref"), F.col("p_name").alias("name"), aliases, F.array(F.concat("p_name", F.lit(" holds")), F.lit("nothing")).alias("evidence_quotes")).distinct()
    said = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("none"))).otherwise(F.array("s_name"))
    suppliers = rows.select("chunk_id", F.col("supplier").alias("entity_ref"), F.col("s_name").alias("name"), aliases, said.alias("evidence_quotes")).distinct()
    links = rows.select("chunk_id", "relationship_ref", F.col("part").alias("source_entity_ref"), F.col("supplier").alias("target_entity_ref"), F.concat_ws(" of ", "p_name", "s_name").alias("evidence_quote"))
    held = F.array_sort(F.collect_list(F.struct("n", "part", "relationship_ref", "p_size")))
    requirements = rows.groupBy("chunk_id").agg(held.alias("h")).select(
        "chunk_id", F.lit("r").alias("requirement_ref"), F.transform(F.filter("h", lambda x: x["p_size"] > 45), lambda x: x["part"]).alias("entity_refs"), F.transform("h", lambda x: x["relationship_ref"]).alias("relationship_refs"))
    return pruning.Extraction(requirements, parts.unionByName(suppliers), links)


@R.query("""
WITH l AS (SELECT l_orderkey AS c, n, l_partkey AS p, l_suppkey AS s, p_size FROM (""" + _NUMBERED + """) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
     e AS (SELECT c, 's' || s AS e FROM l WHERE s % 3 <> 0 UNION SELECT c, 'p' || p FROM l WHERE s % 3 <> 0 OR p_size > 45)
SELECT c AS chunk_id, coalesce((SELECT string_agg(e, ',' ORDER BY e) FROM e WHERE e.c = l.c), '') AS entities, coalesce(string_agg('p' || p, ',' ORDER BY n) FILTER (WHERE p_size > 45), '') AS entity_refs,
       coalesce(string_agg('k' || n, ',' ORDER BY n) FILTER (WHERE s % 3 <> 0), '') AS relationship_refs FROM l GROUP BY c""")
def pruned_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third supplier isn't grounded: it goes with its relationships, and so do parts that nothing else names."""
    left = pruning.prune_relationships(pruning.prune_entities(_extraction(spark, sf_dir)))
    entities = left.entities.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list("entity_ref")), ",").alias("entities"))
    refs = left.requirements.select("chunk_id", F.array_join("entity_refs", ",").alias("entity_refs"), F.array_join("relationship_refs", ",").alias("relationship_refs"))
    return refs.join(entities, "chunk_id", "left").select("chunk_id", F.coalesce("entities", F.lit("")).alias("entities"), "entity_refs", "relationship_refs")


@R.query("""
WITH q AS (SELECT o_orderkey AS c, n, CASE n % 4 WHEN 0 THEN 'status ' || o_orderstatus || ' late' WHEN 1 THEN substr(o_orderpriority, 3) WHEN 2 THEN ' status' || chr(10) || o_orderstatus ELSE 'status X' END AS q, o_orderpriority AS a, 'status ' || o_orderstatus AS b
           FROM orders JOIN (""" + _NUMBERED + r""") ON l_orderkey = o_orderkey),
     t AS (SELECT c, n, trim(regexp_replace(q, '\s+', ' ', 'g')) AS q, a, b FROM q)
SELECT c AS chunk_id, 'k' || n AS relationship_ref, contains(q, a) OR contains(a, q) OR contains(q, b) OR contains(b, q) AS inside FROM t""")
def relationship_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requirements with two quotes, lines as relationships whose quote holds one, is held by one, has other white space, or neither."""
    both = table(spark, sf_dir, "orders").join(_numbered_lines(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    n, status = F.col("n") % 4, F.concat(F.lit("status "), "o_orderstatus")
    quote = F.when(n == 0, F.concat(status, F.lit(" late"))).when(n == 1, F.substring("o_orderpriority", 3, 99)).when(n == 2, F.concat(F.lit(" status\n"), "o_orderstatus")).otherwise("status X")
    links = both.select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("k"), "n").alias("relationship_ref"), quote.alias("evidence_quote"))
    requirements = both.groupBy(F.col("o_orderkey").alias("chunk_id"), "o_orderpriority", "o_orderstatus").agg(F.collect_list(F.concat(F.lit("k"), "n")).alias("relationship_refs"))
    return discovery.owned_relationships(requirements.withColumn("evidence_quotes", F.array("o_orderpriority", status)), links).select("chunk_id", "relationship_ref", "inside")


@R.query("""
WITH e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b, (n_nationkey * 7) % 11 * 100 + n_nationkey AS p FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, (s_suppkey * 7) % 11 * 1000000 + s_suppkey FROM supplier),
     f AS (SELECT a AS seed, b AS node, 1 AS depth, p AS p1, 0 AS p2 FROM e WHERE a LIKE 'r%' UNION ALL SELECT x.a, y.b, 2, x.p, y.p FROM e x JOIN e y ON y.a = x.b WHERE x.a LIKE 'r%')
SELECT seed, node, depth, row_number() OVER (PARTITION BY seed ORDER BY depth, p1, p2)::INT AS pos FROM f""")
def neighbours_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From regions to nations and suppliers, in the order in which a search finds them."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    place = lambda key, step: ((F.col(key) * 7) % 11 * step + F.col(key)).cast("long").alias("place")
    edges = n.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"), place("n_nationkey", 100)).unionByName(
        s.select(name("n", "s_nationkey").alias("source"), name("s", "s_suppkey").alias("target"), place("s_suppkey", 1_000_000)))
    seeds = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("seed"))
    order = Window.partitionBy("seed").orderBy("depth", "way")
    return graph.neighbours_in_order(seeds, edges, 4, "place").select("seed", "node", "depth", F.row_number().over(order).alias("pos"))


@R.query("""
SELECT DISTINCT l_orderkey AS story_id, l_partkey AS chunk_id FROM lineitem""")
def accumulated_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges of early lines stay when orders are stored again with their late lines only, some of them twice."""
    lines = table(spark, sf_dir, "lineitem")
    old = lines.filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("chunk_id")).distinct()
    new = lines.filter("l_linenumber >= 3").groupBy(F.col("l_orderkey").alias("story_id")).agg(F.collect_list("l_partkey").alias("chunks"))
    _, bridges = store.upsert_with_children(new.select("story_id").limit(0), new, ["story_id"], {"chunks": (old, "chunks", "chunk_id")})
    return bridges["chunks"]


@R.query("""
WITH o AS (SELECT o_orderpriority AS project, o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT project, status, count(*)::BIGINT AS n, count(DISTINCT o_orderkey)::BIGINT AS keys FROM o GROUP BY ALL""")
def orders_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as projects of one table: stored, one dropped, one updated in part, and read back."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("project"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    stored = Table(spark, _scratch(spark), "project")
    stored.overwrite(orders)
    stored.delete(["1-URGENT"])
    stored.upsert(orders.filter("project = '2-HIGH' AND o_orderkey % 2 = 0").withColumn("status", F.lit("X")), ["project", "o_orderkey"])
    return stored.read().groupBy("project", "status").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))


@R.query("""
WITH l AS (SELECT l_orderkey AS c, l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT o_orderkey::VARCHAR AS source, 'IMPLEMENTS' AS relation, 'S' || o_custkey AS target FROM orders UNION SELECT o_orderkey::VARCHAR, 'USES_TEST_DATA', 'T' || o_orderstatus FROM orders UNION SELECT o_orderkey::VARCHAR, 'GENERATED_IN', 'F' || o_orderpriority FROM orders
UNION SELECT c::VARCHAR, 'TRACES_TO', 'U' || p FROM orders JOIN l ON c = o_orderkey UNION SELECT c::VARCHAR, 'VERIFIES', 'Q' || s FROM orders JOIN l ON c = o_orderkey UNION SELECT o_orderkey::VARCHAR, 'GENERATED_FILE', 'tests/' || o_orderkey || '.py' FROM orders""")
def case_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as accepted cases, their lines' parts as stories and suppliers as requirements."""
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(name("U", "l_partkey")).alias("story_ids"), F.collect_list(name("Q", "l_suppkey")).alias("requirement_ids"))
    cases = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("tc_id"), F.lit("ACCEPTED").alias("status"), name("S", "o_custkey").alias("scenario_id"), "story_ids", "requirement_ids", name("T", "o_orderstatus").alias("test_data_snapshot_id"),
        name("F", "o_orderpriority").alias("framework_snapshot_id"), F.array(F.concat(F.lit("tests/"), F.col("o_orderkey").cast("string"), F.lit(".py"))).alias("generated_files"))
    return projection.case_edges(cases).select("source", "relation", "target")


@R.query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS moment, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def iso_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and days as the text of a workbook's cells."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", workbook.iso_cell(F.col("ts"), dict(events.dtypes)["ts"]).alias("moment"), workbook.iso_cell(F.col("ts").cast("date"), "date").alias("day"))


@R.query("""
WITH o AS (SELECT o_custkey AS run_id, o_orderstatus <> 'P' AS ok FROM orders)
SELECT run_id, CASE WHEN bool_and(ok) THEN 'COMPLETED' ELSE 'PARTIAL_FAILED' END AS run_status FROM o GROUP BY run_id""")
def run_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs of their orders, whose results have the frozen ids in their order."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    results = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), place.alias("pos"), F.col("o_orderkey").cast("string").alias("scenario_id"), F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("ACCEPTED").alias("status"))
    return readiness.run_exit(results.drop("status"), results)


@R.query()
def vector_index_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 nearest of the rows whose id is divisible by 100, among all rows, by half the lists of an inverted file; tests measure recall."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = vector_index.InvertedFile.build(vectors, _scratch(spark), 32)
    return index.search(vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 12, 16).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@R.query("SELECT o_orderkey, o_orderstatus FROM orders")
def verified_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the orders are there already; all are offered, the others are added, and none differs."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return store.insert_or_verify(orders.filter("o_orderkey % 2 = 0"), orders, ["o_orderkey"], "o_orderstatus")


@R.query("SELECT o_orderkey AS snapshot_id FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def removable_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots, urgent ones active, lines as what refers to them."""
    snapshots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), (F.col("o_orderpriority") == "1-URGENT").alias("active"))
    return store.removable_snapshots(snapshots, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"))).select("snapshot_id")


@R.query("""
SELECT p_partkey, 'sha256:' || sha256('{"a":{"size":' || p_size || '},"name":"' || p_name || '","tags":["' || p_brand || '",null,' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || ']}') AS checksum FROM part""")
def json_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of JSON with its keys in another order, a list, and a time that doesn't count."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    payload = F.concat(
        F.lit('{ "tags": ['), quoted("p_brand"), F.lit(", null, "), (F.col("p_size") > 25).cast("string"), F.lit('], "name": '), quoted("p_name"),
        F.lit(', "generated_at": '), F.col("p_partkey").cast("string"), F.lit(', "a": {"size": '), F.col("p_size").cast("string"), F.lit("}}"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", ids.json_checksum(payload).alias("checksum"))


@R.query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE -1 END::INT AS start, CASE s_suppkey % 4 WHEN 0 THEN 3 + length(s_name) WHEN 1 THEN 3 + length(s_name) WHEN 2 THEN 5 + length(s_name) ELSE -1 END::INT AS "end" FROM supplier""")
def quote_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that stand in their source, with other white space before or after, or not at all (-1)."""
    kind, name = F.col("s_suppkey") % 4, F.col("s_name")
    source = F.concat(F.lit("a \n"), name, F.lit("\tb"))
    quote = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit("a "), name)).when(kind == 2, F.concat(name, F.lit("  b"))).otherwise(F.concat(F.lit("b "), name))
    return table(spark, sf_dir, "supplier").select("s_suppkey", discovery.quote_spans(source, quote).alias("s")).select("s_suppkey", *(F.coalesce(f"s.{x}", F.lit(-1)).alias(x) for x in ("start", "end")))


@R.query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'never' WHEN 2 THEN 'within,' || p_size || ' s' ELSE 'shall,never,within,' || p_size || ' s' END AS lost FROM part""")
def lost_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requirements, restated whole, without a word of refusal, without their time, or without all of these."""
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    source = F.concat(F.lit("Rule 2.1: it shall never close within "), size, F.lit(" s"))
    said = F.when(kind == 0, F.concat(F.lit("It  SHALL never close WITHIN "), size, F.lit(" s."))).when(kind == 1, F.concat(F.lit("It shall close within "), size, F.lit(" s."))).when(kind == 2, F.lit("It shall never close.")).otherwise(F.lit("It closes."))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(discovery.lost_markers(source, said), ",").alias("lost"))


@R.query("""
WITH l AS (SELECT o_orderkey AS k, 'BR-' || l_linenumber AS id, 'part ' || l_partkey AS text, n FROM orders JOIN (""" + _NUMBERED + """) ON l_orderkey = o_orderkey),
     f AS (SELECT k, id, max_by(text, n) AS text, min(n) AS first FROM l GROUP BY k, id)
SELECT k AS o_orderkey, string_agg(id || '=' || text, ';' ORDER BY first) AS rows FROM f GROUP BY k""")
def id_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts of their lines, an id and a part each, between other lines; of an id that repeats the last text counts, at the first place."""
    line = F.struct("n", F.concat(F.lit("  BR-"), "l_linenumber", F.lit(" \t part "), "l_partkey", F.lit("\r\nother BR-1 line\n")).alias("t"))
    texts = _numbered_lines(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    found = text.explicit_rows(F.array_join(F.transform("l", lambda x: x["t"]), ""))
    return texts.select("o_orderkey", F.array_join(F.transform(found, lambda r: F.concat_ws("=", r["id"], r["text"])), ";").alias("rows"))


@R.query("""
WITH c AS (SELECT o_custkey AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, lower(o_orderpriority) || '|' || o_orderkey || '|' || lower(o_orderstatus) || '|' AS content FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN 'OLD-' || k ELSE 'AC-' || upper(substr(sha256(s || '|' || ordinal || '|' || content), 1, 18)) END AS criterion_id FROM c""")
def criterion_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as criteria of their customers' stories: every third was there before, and keeps its id."""
    ordinal = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    criteria = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("story_id"), ordinal.alias("ordinal"), F.concat(F.lit(" "), "o_orderpriority").alias("title"), F.col("o_orderkey").cast("string").alias("given"), F.col("o_orderstatus").alias("when"),
        F.lit(None).cast("string").alias("then"), "o_orderkey")
    content = F.concat(F.lower(F.trim("title")), F.lit("|"), F.col("given"), F.lit("|"), F.lower("when"), F.lit("|"))
    prior = criteria.filter("o_orderkey % 3 = 0").select("story_id", content.alias("content"), F.concat(F.lit("OLD-"), F.col("o_orderkey").cast("string")).alias("criterion_id"))
    return canon.criterion_ids(criteria, prior).select("o_orderkey", "criterion_id")
