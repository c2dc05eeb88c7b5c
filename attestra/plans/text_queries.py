"""Queries over texts: identities, normalization, terms, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import ids, text
from attestra.functions.json_text import explode_leaves, is_placeholder, is_plain_secret
from attestra.operators import canon
from attestra.operators.chunking import chunk_blocks, manifest, manifest_issues
from attestra.plans.registry import Registry, table
from attestra.sources.documents import text_blocks

R = Registry()
#: The same folding in DuckDB's SQL.
SQL_FOLD = r"replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), 'ß', 'ss')"


@R.query(r"""
SELECT doc_id, upper(substr(sha256(concat_ws('|', lang, source, doc_id::VARCHAR)), 1, 20)) AS token,
       'CHK-' || upper(substr(sha256(concat_ws('|', text, '0', length(text)::VARCHAR, '')), 1, 20)) AS chunk_id,
       'sha256:' || sha256(text) AS content_hash
FROM documents""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "documents").select(
        "doc_id", ids.stable_token(c("lang"), c("source"), c("doc_id")).alias("token"),
        ids.chunk_id(c("text"), F.lit(0), F.length("text"), F.lit(None)).alias("chunk_id"), ids.content_hash(c("text")).alias("content_hash"),
    )


@R.query(r"""
SELECT doc_id, sha256(trim(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\f\v]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS normalized
FROM documents""")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("normalized"))


@R.query(f"""
SELECT sha256({SQL_FOLD.format('text')}) AS key, min(doc_id) AS first_doc, count(*)::BIGINT AS n_docs FROM documents GROUP BY 1""")
def texts_by_folded_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("key"))
    first = canon.first_per(keyed, ["key"], ["doc_id"]).select("key", F.col("doc_id").alias("first_doc"))
    return first.join(keyed.groupBy("key").agg(F.count("*").alias("n_docs")), "key")


@R.query("""
WITH e AS (SELECT 'ENT-' || upper(substr(sha256(concat_ws('|', 'corpus', lower(p_name), p_type)), 1, 20)) AS entity_id, p_partkey AS k, p_name, p_type, p_brand FROM part),
     a AS (SELECT entity_id, p_brand, min(k) AS k FROM e GROUP BY ALL)
SELECT entity_id, min_by(p_name, k) AS name, any_value(p_type) AS entity_type, (SELECT string_agg(p_brand, ',' ORDER BY a.k) FROM a WHERE a.entity_id = e.entity_id) AS aliases, count(*)::BIGINT AS n_mentions FROM e GROUP BY entity_id""")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as mentions of entities: those of one name and type are one."""
    rows = table(spark, sf_dir, "part").select(
        ids.entity_id(F.lit("corpus"), F.col("p_name"), F.col("p_type")).alias("entity_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"),
        F.array("p_brand").alias("aliases"), F.col("p_partkey").alias("chunk_id"), F.lit(0).alias("start"), F.length("p_name").alias("end"),
    )
    return canon.merge_entities(rows).select("entity_id", "name", "entity_type", F.array_join("aliases", ",").alias("aliases"), F.size("mentions").cast("long").alias("n_mentions"))


@R.query("""
WITH r AS (SELECT p_partkey % 5000 AS id, p_name AS text FROM part UNION ALL SELECT s_suppkey, 'small ring' FROM supplier)
SELECT 'S' || id AS source_req_id, count(DISTINCT text)::BIGINT AS n FROM r GROUP BY 1 HAVING count(DISTINCT text) > 1""")
def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requirements of source ids, and suppliers as the rows of an earlier run; an id with several texts is in conflict."""
    of = lambda df, key, said: df.select(F.concat(F.lit("S"), key).alias("source_req_id"), F.lit("source").alias("source_req_id_type"), said.alias("requirement_text"))
    rows = of(table(spark, sf_dir, "part"), F.col("p_partkey") % 5000, F.col("p_name"))
    found = canon.source_conflicts(rows, of(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.lit("small ring")))
    return found.select("source_req_id", F.col(found.columns[1]).alias("n"))


@R.query(r"""
WITH s AS (SELECT s_suppkey, regexp_replace(regexp_replace(lower(trim(CASE WHEN s_suppkey % 3 = 0 THEN ' #! ' ELSE s_name END)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM supplier)
SELECT s_suppkey, CASE WHEN x = '' THEN 'project' ELSE x END AS slug, substr('chunks-' || CASE WHEN x = '' THEN 'project' ELSE x END, 1, 63) AS collection FROM s""")
def project_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third supplier has a name of which nothing is left."""
    name = F.when(F.col("s_suppkey") % 3 == 0, " #! ").otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.slug(name).alias("slug"), text.collection_name("chunks", name).alias("collection"))


_STOP = "'and', 'are', 'for', 'from', 'into', 'should', 'that', 'the', 'then', 'this', 'when', 'with'"


@R.query(f"""
WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})) AS l FROM documents),
     e AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM w),
     f AS (SELECT doc_id, t, min(i) AS i FROM e GROUP BY doc_id, t),
     r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT d.doc_id, coalesce(string_agg(t, ' ' ORDER BY i) FILTER (WHERE n <= 12), '') AS terms FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@R.query(r"""
SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END::INT AS words,
       greatest(1, length(text) // 4)::INT AS quarters, greatest(1, ceil(length(text) / 4.0))::INT AS quarters_up
FROM documents""")
def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.count_words(t).cast("int").alias("words"), text.count_quarters(t).alias("quarters"), text.count_quarters_up(t).alias("quarters_up"))


@R.query(r"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS stem FROM part""")
def pascal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.pascal_title(F.col("p_name")).alias("stem"))


@R.query(r"""
SELECT event_id, 'props.k' AS path, 'number' AS kind, json_extract_string(props, '$.k') AS value, false AS placeholder, false AS secret FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
UNION ALL SELECT event_id, 'steps[0].note', 'string', CASE WHEN event_id % 3 = 0 THEN ' tbd ' ELSE event_type END, event_id % 3 = 0, false FROM events
UNION ALL SELECT event_id, 'steps[0].api_key', 'string', CASE WHEN event_id % 2 = 0 THEN 'secret://' ELSE '' END || event_type, false, event_id % 2 <> 0 FROM events
UNION ALL SELECT event_id, 'steps[1]', 'boolean', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, false, false FROM events""")
def payload_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with objects in lists: every third has a placeholder, every other one a secret in plain text."""
    events = table(spark, sf_dir, "events")
    note, key = F.when(F.col("event_id") % 3 == 0, " tbd ").otherwise(F.col("event_type")), F.concat(F.when(F.col("event_id") % 2 == 0, "secret://").otherwise(""), "event_type")
    step = F.to_json(F.struct(note.alias("note"), key.alias("api_key")))
    payload = F.concat(F.lit('{"props":'), "props", F.lit(',"steps":['), step, F.lit(","), (F.col("user_id") % 2 == 0).cast("string"), F.lit("]}"))
    leaves = explode_leaves(events.select("event_id", payload.alias("props")), "props")
    return leaves.select("event_id", "path", "kind", "value", is_placeholder(F.col("value")).alias("placeholder"), is_plain_secret(F.col("key"), F.col("value")).alias("secret"))


#: Lines as blocks of their own, some with a heading before them; the text that blocks and chunks are made of, and its blocks.
_SQL_NORMAL = r"trim(regexp_replace(array_to_string(list_transform(string_split({0}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\f\v]+', ' ', 'g'))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_SQL_BLOCKS = r"""
WITH RECURSIVE t AS (SELECT doc_id::VARCHAR AS doc_key, CASE doc_id % 3 WHEN 0 THEN '# ' WHEN 1 THEN '- ' ELSE '#' || chr(10) || chr(10) END || replace(text, chr(10), chr(10) || ' ' || chr(10) || '  ') AS text FROM documents),
     l AS (SELECT doc_key, regexp_split_to_array(text, '\n\s*\n') AS parts, list_transform(regexp_extract_all(text, '\n\s*\n'), lambda x: length(x)) AS seps FROM t),
     u AS (SELECT doc_key, unnest(parts) AS part, unnest(list_append(seps, 0)) AS sep, generate_subscripts(parts, 1) AS paragraph FROM l),
     o AS (SELECT doc_key, part, paragraph, coalesce(sum(length(part) + sep) OVER (PARTITION BY doc_key ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS s, regexp_replace(part, '^\s+|\s+$', '', 'g') AS raw FROM u),
     k AS (SELECT *, s + length(part) AS e, CASE WHEN raw LIKE '#%' THEN nullif(trim(ltrim(raw, '#')), '') END AS name FROM o WHERE raw <> ''),
     blocks AS (SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY paragraph) - 1 AS pos, """ + _SQL_NORMAL.format("raw") + r""" AS text, s, e::INT AS e,
                       CASE WHEN raw LIKE '#%' THEN 'heading' WHEN regexp_matches(raw, '^[-*+]') THEN 'list_item' ELSE 'paragraph' END AS kind,
                       last_value(name IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, 'char=' || s || ':' || e AS location FROM k)"""
#: Blocks to chunks: pieces of long blocks one after another, then pieces into groups one after another.
_SQL_CHUNKS = r"""
     w AS (SELECT * FROM blocks WHERE text <> ''),
     f AS (SELECT doc_key, pos, text, s, e, section, location, 0 AS a, CASE WHEN length(text) <= 2000 THEN length(text) ELSE 0 END AS b, length(text) AS n FROM w
           UNION ALL SELECT doc_key, pos, text, s, e, section, location, nxt, CASE WHEN nxt + 2000 >= n THEN n WHEN strpos(back, ' ') > 0 THEN nxt + 2000 - strpos(back, ' ') ELSE nxt + 2000 END, n
                     FROM (SELECT *, reverse(translate(substr(text, nxt + 1001, 1000), chr(10), ' ')) AS back FROM (SELECT *, CASE WHEN b = 0 THEN 0 ELSE greatest(a + 1, b - 150) END AS nxt FROM f WHERE b < n))),
     c AS (SELECT doc_key, pos, section, location, a, CASE WHEN n <= 2000 THEN text ELSE trim(substr(text, a + 1, b - a), ' ' || chr(10)) END AS text, CASE WHEN n <= 2000 THEN s ELSE least(e, s + a) END AS s, CASE WHEN n <= 2000 THEN e ELSE least(e, s + b) END AS e FROM f WHERE b > 0),
     p AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY pos, a) AS i, length(text) AS n FROM c WHERE text <> ''),
     g AS (SELECT doc_key, i, 0 AS g, n AS size, n >= 1200 AS full FROM p WHERE i = 1
           UNION ALL SELECT p.doc_key, p.i, CASE WHEN g.full OR g.size + 2 + p.n > 1200 THEN g.g + 1 ELSE g.g END, CASE WHEN g.full OR g.size + 2 + p.n > 1200 THEN p.n ELSE g.size + 2 + p.n END, p.n >= 1200
                     FROM g JOIN p ON p.doc_key = g.doc_key AND p.i = g.i + 1),
     chunks AS (SELECT p.doc_key, g.g::INT AS sequence_index, string_agg(p.text, chr(10) || chr(10) ORDER BY p.i) AS chunk_text, min_by(p.s, p.i)::INT AS s, max_by(p.e, p.i)::INT AS e,
                       arg_min_null(p.section, p.i) AS section, arg_min_null(p.location, p.i) AS location FROM p JOIN g ON p.doc_key = g.doc_key AND p.i = g.i GROUP BY ALL)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_key, text) with empty lines between lines, and a heading, a list item, or a heading without a name at the front."""
    front = F.when(F.col("doc_id") % 3 == 0, "# ").when(F.col("doc_id") % 3 == 1, "- ").otherwise("#\n\n")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.concat(front, F.replace("text", F.lit("\n"), F.lit("\n \n  "))).alias("text"))


@R.query(_SQL_BLOCKS + " SELECT doc_key, pos, sha256(text) AS text_hash, s AS start, e AS \"end\", kind, section, location FROM blocks")
def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = text_blocks(_marked(spark, sf_dir))
    return blocks.select("doc_key", "pos", F.sha2("text", 256).alias("text_hash"), "start", "end", "kind", "section", "location")


@R.query(_SQL_BLOCKS + "," + _SQL_CHUNKS + """
SELECT 'corpus' AS project, 'RUN-1' AS run_id, 'CHK-' || upper(substr(sha256(concat_ws('|', chunk_text, s::VARCHAR, e::VARCHAR, location)), 1, 20)) AS chunk_id, doc_key, sequence_index, chunk_text,
       'sha256:' || sha256(chunk_text) AS content_hash, s AS start_char, e AS end_char, section, location AS source_location, 'pending' AS graph_status, 'pending' AS vector_status FROM chunks""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(chunk_blocks(text_blocks(_marked(spark, sf_dir))), "corpus", "RUN-1").drop("block_types")


@R.query("WITH RECURSIVE x AS (SELECT doc_id::VARCHAR AS doc_key, string_split(text, chr(10)) AS l FROM documents), y AS (SELECT doc_key, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM x),"
         " blocks AS (SELECT doc_key, pos, " + _SQL_NORMAL.format("raw") + " AS text, 0 AS s, length(raw)::INT AS e, NULL::VARCHAR AS section, NULL::VARCHAR AS location FROM y WHERE raw <> '')," + _SQL_CHUNKS + """
SELECT doc_key, sequence_index, s AS start_char, e AS end_char, length(chunk_text)::INT AS n_chars, sha256(chunk_text) AS chunk_hash FROM chunks""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks; some are longer than a chunk may be."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    blocks = docs.filter("text <> ''").select("doc_key", "pos", "text", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("location"))
    return chunk_blocks(blocks).select("doc_key", "sequence_index", "start_char", "end_char", F.length("chunk_text").alias("n_chars"), F.sha2("chunk_text", 256).alias("chunk_hash"))


@R.query("""
WITH d AS (SELECT doc_id, doc_id::VARCHAR AS doc_key FROM documents WHERE trim(text) <> '')
SELECT doc_key, 'NOT_PERSISTED' AS issue FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT doc_key, 'INDEX_NOT_CONTIGUOUS' FROM d WHERE doc_id % 3 = 0
UNION ALL SELECT doc_key, 'HASH_MISMATCH' FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT doc_key, 'SPAN_REVERSED' FROM d WHERE doc_id % 7 = 0""")
def unpublished_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of documents, of which every second isn't stored, and others have places, hashes or spans that are wrong."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), "text")
    made, each = manifest(chunk_blocks(text_blocks(docs)), "corpus", "RUN-1"), lambda n: F.col("doc_key").cast("long") % n == 0
    state = F.when(each(2), "pending").otherwise("persisted")
    return manifest_issues(
        made.withColumn("graph_status", F.lit("persisted")).withColumn("vector_status", state)
        .withColumn("sequence_index", F.col("sequence_index") + F.when(each(3), 1).otherwise(0))
        .withColumn("content_hash", F.when(each(5), "sha256:0").otherwise(F.col("content_hash")))
        .withColumn("end_char", F.when(each(7), -1).otherwise(F.col("end_char")))
    )


@R.query(f"""
WITH k AS (SELECT {SQL_FOLD.format('text')} AS key, conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS pos FROM conversations),
     f AS (SELECT key, conv_id, min(pos) AS p FROM k GROUP BY key, conv_id)
SELECT CASE WHEN key LIKE '%a' THEN 'OLD-' || sha256(key) ELSE 'US-' || upper(substr(sha256(concat_ws('|', 'corpus', '', 'generated', key)), 1, 20)) END AS id, string_agg(conv_id::VARCHAR, ',' ORDER BY p) AS parents, count(*)::BIGINT AS n_parents FROM f GROUP BY key""")
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(
        F.lit(None).cast("string").alias("source_req_id"), F.lit("generated").alias("source_req_id_type"), "text", F.col("conv_id").cast("string").alias("parent"),
        F.struct("conv_id", "turn").alias("pos"), F.lit(1.0).alias("confidence"),
    )
    key = text.fold(F.col("text"))
    earlier = rows.filter(key.endswith("a")).select("source_req_id", "source_req_id_type", key.alias("key"), F.concat(F.lit("OLD-"), F.sha2(key, 256)).alias("id")).distinct()
    merged = canon.merge_candidates(rows, key, earlier, "US", "corpus", "parent", [])
    return merged.select("id", F.array_join("parents", ",").alias("parents"), F.size("parents").cast("long").alias("n_parents"))
