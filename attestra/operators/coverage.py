"""What is covered by what, and how many candidates each anchor gave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(requirements: DataFrame, stories: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row: numbers of (requirement_id), (story_id, requirement_id), (scenario_id, story_id) rows, and of requirements and stories with something below."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(requirements, "n_requirements"), count(stories, "n_stories"), count(scenarios, "n_scenarios"),
        count(requirements.join(stories, "requirement_id", "left_semi"), "requirements_covered"), count(stories.join(scenarios, "story_id", "left_semi"), "stories_covered"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # each side is one row
    return out


def progress(anchors: DataFrame, candidates: DataFrame, key: str, none: str) -> DataFrame:
    """(key, n, status) of every anchor: 'generated', or ``none`` where nothing came of it."""
    n = candidates.groupBy(key).agg(F.count("*").alias("n"))
    return anchors.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), none).otherwise("generated").alias("status"))
