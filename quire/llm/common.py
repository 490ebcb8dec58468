"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(sections: DataFrame, key: str = "section_key", at: str = "loaded_at") -> DataFrame:
    """Each section once: of rows that came again, the one loaded first.

    Only the keys that came again (two narrow columns) are gathered and joined, so the texts aren't shuffled when those are few."""
    again = sections.groupBy(key).agg(F.count("*").alias("_n"), F.min(at).alias("_first")).where("_n > 1").select(key, "_first")
    return sections.join(again, key, "left").where(F.col("_first").isNull() | (F.col(at) == F.col("_first"))).drop("_first")
