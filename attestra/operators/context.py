"""What goes into a context: candidates by terms, tiers and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import count_quarters, count_quarters_up, fold
from attestra.operators.retrieval import within_budget

#: Fixed value: the group whose items are no symbols.
EVIDENCE_GROUP = "evidence_chunks"


def symbol_matches(terms: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """(anchor, term) and symbols to the symbols whose name has a term, most terms first: (anchor, symbol_id, fqn, n_terms, rank).

    Containment is found by equality: a term's first three characters are looked up
    among the distinct parts of one, two and three characters of names (of one and two only
    if a term is that short), then the term is searched in the name. Empty terms match nothing.
    """
    name = fold(F.col("fqn"))
    asked = terms.select("anchor", fold(F.col("term")).alias("term")).filter("term <> ''").distinct().withColumn("part", F.substring("term", 1, 3))
    sizes = sorted(r[0] for r in asked.select(F.length("part")).distinct().collect()) or [3]  # three at most
    of_size = lambda n: F.when(F.length("name") >= n, F.transform(F.sequence(F.lit(1), F.length("name") - (n - 1)), lambda i: F.substring(F.col("name"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.concat(*(of_size(n) for n in sizes)))
    keyed = symbols.select("symbol_id", "fqn", name.alias("name")).withColumn("part", F.explode(parts))
    hits = asked.join(keyed, "part").filter(F.contains("name", "term"))
    counted = hits.groupBy("anchor", "symbol_id", "fqn").agg(F.countDistinct("term").alias("n_terms"))
    order = Window.partitionBy("anchor").orderBy(F.col("n_terms").desc(), fold(F.col("fqn")), "symbol_id")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def search_symbols(symbols: DataFrame, query: str, kinds: tuple[str, ...] | None, limit: int) -> DataFrame:
    """Symbols whose name has the query in any case, in order of name and id."""
    found = symbols.filter(fold(F.col("fqn")).contains(query.casefold()))
    return (found.filter(F.col("kind").isin(*kinds)) if kinds else found).orderBy("fqn", "symbol_id").limit(limit)


def selected_symbols(explicit: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """(anchor, symbol_id, pos): explicit ones first, then hits, each once, at most ``limit``."""
    both = explicit.select("anchor", "symbol_id", F.lit(0).alias("source"), "pos").unionByName(hits.select("anchor", "symbol_id", F.lit(1).alias("source"), F.col("rank").alias("pos")))
    first = Window.partitionBy("anchor", "symbol_id").orderBy("source", "pos")
    kept = both.withColumn("n", F.row_number().over(first)).filter("n = 1")
    order = Window.partitionBy("anchor").orderBy("source", "pos")
    return kept.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit).select("anchor", "symbol_id", "pos")


def assemble_manifest(items: DataFrame, budget: int) -> DataFrame:
    """(anchor, tier, pos, text, item_id): tier 0 is free and always in; others if they fit, at a quarter of their characters."""
    return within_budget(items, "anchor", ["tier", "pos"], count_quarters(F.col("text")), budget, keep_first=False, free=F.col("tier") == 0)


def apply_budget(items: DataFrame, budget: int, max_symbols: int) -> DataFrame:
    """(anchor, tier, group, key, json): in or out by cost and by number of symbols (what is no evidence chunk), each with ``kept``."""
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.lit(0).alias("symbols"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        symbol = (item["group"] != EVIDENCE_GROUP).cast("int")
        fits = (acc["spent"] + item["cost"] <= budget) & ((symbol == 0) | (acc["symbols"] < max_symbols))
        return F.struct((acc["spent"] + F.when(fits, item["cost"]).otherwise(F.lit(0).cast("long"))).alias("spent"), (acc["symbols"] + F.when(fits, symbol).otherwise(0)).alias("symbols"), F.concat(acc["kept"], F.array(fits)).alias("kept"))

    costed = items.withColumn("cost", count_quarters_up(F.col("json")).cast("long"))
    held = costed.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("tier", "group", "key", "json", "cost"))).alias("items"))
    kept = F.aggregate("items", start, step, lambda acc: acc["kept"])
    return held.select("anchor", F.explode(F.zip_with("items", kept, lambda i, k: F.struct(i.alias("i"), k.alias("kept")))).alias("x")).select("anchor", "x.i.*", "x.kept")


def dropped_counts(budgeted: DataFrame) -> DataFrame:
    return budgeted.groupBy("anchor", "group").agg(F.count_if(~F.col("kept")).alias("dropped")).filter("dropped > 0")
