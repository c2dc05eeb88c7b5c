"""Structured test data: rows of sheets or JSON documents to records, bindings and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header_issues(header: list[str], required: tuple[str, ...]) -> list[str]:
    """What is wrong with a sheet's header; a header is a few names."""
    names = [x.strip() for x in header]
    return [f"duplicate column {x}" for x in sorted({x for x in names if names.count(x) > 1})] + [f"missing column {x}" for x in required if x not in names]


def to_bool(cell: Column) -> Column:
    text = F.lower(F.trim(cell))
    return F.when(text.isin("true", "yes", "y", "1"), True).when(text.isin("false", "no", "n", "0"), False)


def to_list(cell: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def is_formula(cell: Column) -> Column:
    return F.coalesce(cell.startswith("="), F.lit(False))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, column, value) to one row a sheet row: (sheet, row, cells map, has_formula); empty rows go."""
    filled = cells.filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    return filled.groupBy("sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "value")))).alias("cells"), F.bool_or(is_formula(F.col("value"))).alias("has_formula"))


def records_of(rows: DataFrame) -> DataFrame:
    """Sheet rows to records; columns named ``payload.*`` make the payload."""
    payload = F.map_filter("cells", lambda k, v: k.startswith("payload."))
    named = F.transform_keys(payload, lambda k, v: F.regexp_replace(k, r"^payload\.", ""))
    get = lambda name: F.col("cells")[name]
    return rows.select(
        get("record_id").alias("record_id"), F.col("sheet").alias("record_type"), get("record_status").alias("record_status"), to_bool(get("enabled")).alias("enabled"), get("natural_key").alias("natural_key"),
        get("name").alias("name"), F.to_json(named).alias("payload"), F.col("sheet").alias("source_sheet"), F.col("row").alias("source_row"), "has_formula",
    )


def iso_cell(value: Column, kind: str) -> Column:
    """A date cell (``kind``: date, timestamp or timestamp_ntz) as ISO text: a date's day; a time's day and time, with six decimals if it has any. Other kinds as text."""
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if kind.startswith("timestamp"):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.date_format(value, ".SSSSSS")
        return F.when(part == ".000000", whole).otherwise(F.concat(whole, part))
    return value.cast("string")


def record_issues(records: DataFrame) -> DataFrame:
    """Rows that are no records: an issue each, never an error."""
    why = F.when(F.col("has_formula"), "formula cell").when(F.col("record_id").isNull(), "no record_id").when(F.col("enabled").isNull(), "enabled is no boolean").when(F.col("name").isNull(), "no name")
    return records.withColumn("why", why).filter("why IS NOT NULL").select(
        F.lit("STRUCT_RECORD_INVALID").alias("issue_code"), F.lit("ERROR").alias("severity"), F.col("why").alias("message"), "record_id", F.col("source_sheet").alias("sheet"), F.col("source_row").cast("int").alias("row"), F.lit(None).cast("string").alias("cell")
    )


def unknown_sheet_issues(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    return rows.select("sheet").distinct().filter(~F.col("sheet").isin(*known)).select(
        F.lit("STRUCT_UNKNOWN_SHEET").alias("issue_code"), F.lit("WARNING").alias("severity"), F.concat(F.lit("unknown sheet "), F.col("sheet")).alias("message"), F.lit(None).cast("string").alias("record_id"), "sheet", F.lit(None).cast("int").alias("row"), F.lit(None).cast("string").alias("cell")
    )


def manifest_of(cells: DataFrame) -> DataFrame:
    """(workbook, key, value) of a Manifest sheet, given (workbook, sheet, row, column index from 0, value).

    The first column names the key, the second its value; a first row named key or field
    is a header. A formula is no value, and fails the job.
    """
    own = cells.filter("sheet = 'Manifest' AND col < 2")
    message = F.concat(F.lit("STRUCT_FORMULA_CELL: formula in Manifest row "), F.col("row").cast("string"))
    checked = own.withColumn("value", F.when(is_formula(F.col("value")), F.raise_error(message)).otherwise(F.col("value")))
    at = lambda k: F.max(F.when(F.col("col") == k, F.col("value")))
    rows = checked.groupBy("workbook", "row").agg(F.trim(at(0)).alias("key"), at(1).alias("value")).filter("key <> '' AND NOT (row = 1 AND lower(key) IN ('key', 'field'))")
    return rows.groupBy("workbook", "key").agg(F.max_by("value", "row").alias("value"))


#: What a manifest must say, and the lists of a binding; the sheets that are record types.
MANIFEST_KEYS = ("project", "schema_version", "workbook_checksum")
BINDING_LISTS = ("test_vector_ids", "oracle_ids", "fault_profile_ids", "safety_rule_ids")
BINDING_NEEDS = ("binding_id", "scenario_id", "execution_profile_id", "fixture_id", "cleanup_id", "approval_status")


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(workbook, missing): required keys that a workbook's manifest lacks."""
    needed = F.array(*(F.lit(k) for k in MANIFEST_KEYS))
    held = manifest.filter("value IS NOT NULL").groupBy("workbook").agg(F.collect_set("key").alias("keys"))
    return held.select("workbook", F.explode(F.array_except(needed, "keys")).alias("missing"))


def bindings_of(rows: DataFrame) -> DataFrame:
    """Rows of the Bindings sheet (``sheet_rows``) to bindings; lists are cut at commas, and a variant is the default one unless named."""
    get = lambda name: F.col("cells")[name]
    plain = ("binding_id", "scenario_id", "execution_profile_id", "fixture_id", "action_sequence_id", "cleanup_id", "timing_policy_id", "approval_status")
    return rows.filter("sheet = 'Bindings'").select(
        *(get(c).alias(c) for c in plain), *(to_list(get(c)).alias(c) for c in BINDING_LISTS), F.coalesce(get("variant_id"), F.lit("default")).alias("variant_id"),
        F.coalesce(get("selection_priority").cast("int"), F.lit(0)).alias("selection_priority"), F.col("row").alias("source_row"),
    )


def binding_issues(bindings: DataFrame) -> DataFrame:
    """Bindings that lack a required field or have no oracle: an issue each; and each later occurrence of an id."""
    first = F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c}: required")) for c in BINDING_NEEDS), F.when(F.size("oracle_ids") < 1, F.lit("oracle_ids: at least one")))
    null = lambda kind: F.lit(None).cast(kind)
    issue = lambda df, code, message: df.select(
        F.lit(code).alias("issue_code"), F.lit("ERROR").alias("severity"), message.alias("message"), F.col("binding_id").alias("record_id"), null("string").alias("sheet"), null("int").alias("row"), null("string").alias("cell")
    )
    invalid = issue(bindings.withColumn("why", first).filter("why IS NOT NULL"), "STRUCT_BINDING_INVALID", F.col("why"))
    later = bindings.withColumn("n", F.row_number().over(Window.partitionBy("binding_id").orderBy("source_row"))).filter("n > 1 AND binding_id IS NOT NULL")
    return invalid.unionByName(issue(later, "STRUCT_DUPLICATE_BINDING_ID", F.concat(F.lit("duplicate binding_id '"), F.col("binding_id"), F.lit("'"))))


def object_issues(rows: DataFrame, kind: str) -> DataFrame:
    """(pos, value as JSON) items of a document's records or bindings that are no objects; ``kind`` is RECORD or BINDING."""
    bad = rows.filter(~F.coalesce(F.ltrim("value").startswith("{"), F.lit(False)))
    null = lambda kind: F.lit(None).cast(kind)
    return bad.select(
        F.lit(f"STRUCT_{kind}_NOT_OBJECT").alias("issue_code"), F.lit("ERROR").alias("severity"), F.concat(F.lit(f"{kind.lower()} at position "), F.col("pos").cast("string"), F.lit(" is not an object")).alias("message"),
        null("string").alias("record_id"), null("string").alias("sheet"), (F.col("pos") + 1).cast("int").alias("row"), null("string").alias("cell"),
    )


def read_json_documents(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests, records, bindings) of (doc_key, text) JSON documents: (doc_key, key, value) and two of (doc_key, pos, value as JSON). A text that is no object fails the job."""
    parsed = texts.withColumn("parts", F.from_json("text", "manifest map<string,string>, records array<string>, bindings array<string>"))
    message = F.concat(F.lit("test-data document must be a JSON object: "), F.col("doc_key"))
    whole = F.when(F.ltrim("text").startswith("{") & F.col("parts.manifest").isNotNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    parsed = parsed.filter(whole)
    items = lambda name: parsed.select("doc_key", F.posexplode(F.col(f"parts.{name}")).alias("pos", "value"))
    return parsed.select("doc_key", F.explode("parts.manifest").alias("key", "value")), items("records"), items("bindings")


def read_json_records(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of JSON lines; a line that is no object of the schema is rejected, not fatal."""
    held = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(held).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt IS NULL").drop("_corrupt"), rows.filter("_corrupt IS NOT NULL").select(F.col("_corrupt").alias("line"))
