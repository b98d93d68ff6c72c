"""Stored answers: each is worked out once, and a stored one, even an empty one, stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoopwise.session import dropped, written
from stoopwise.sources.versions import Versions

KEY = ["property_id", "walking_time"]


class Answers:
    """Answers by property and walking time, in fills that are published one by one.

    A fill is a folder of new answers. Asking first looks up what is stored; only
    properties without an answer are worked out, and their answers are added. So a second
    run computes nothing, and a fill that fails is as if it had not begun.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.fills = Versions(spark, root)

    def stored(self) -> DataFrame | None:
        """All stored answers; of two fills with the same key the older counts."""
        rows = None
        for number in self.fills.numbers():
            one = self.fills.read("answers", number=number)["answers"].withColumn("_fill", F.lit(number))
            rows = one if rows is None else rows.unionByName(one)
        return rows

    def ask(
        self, properties: DataFrame, minutes: int, work_out: Callable[[DataFrame, int], DataFrame]
    ) -> DataFrame:
        """property_id, walking_time, response (JSON text) and ``fresh`` per property.

        ``properties`` is unique by property_id. ``work_out`` gives a row with property_id
        and the struct response for each of the properties it is given.
        """
        asked = written(properties.withColumn("walking_time", F.lit(minutes)), "asked")
        before = self.fills.latest() or 0
        stored = self.stored()
        misses = asked if stored is None else asked.join(stored.select(*KEY), KEY, "left_anti")
        misses = written(misses, "misses")
        if not misses.isEmpty():
            answers = work_out(misses.drop("walking_time"), minutes)
            text = F.to_json("response").alias("response")
            self.fills.publish(
                {"answers": answers.select("property_id", F.lit(minutes).alias("walking_time"), text)}
            )
        dropped(misses)
        if (stored := self.stored()) is None:
            nothing = F.lit(None).cast("string").alias("response")
            return asked.select(*KEY, nothing, F.lit(False).alias("fresh"))
        first = stored.groupBy(*KEY).agg(F.min("_fill").alias("_fill"))
        known = stored.join(first, [*KEY, "_fill"])
        return asked.select(*KEY).join(known, KEY).select(*KEY, "response", (F.col("_fill") > before).alias("fresh"))

    def merge_fills(self) -> None:
        """All fills as one, so that a lookup reads few folders; older ones are dropped."""
        rows = self.stored()
        if rows is not None and len(self.fills.numbers()) > 1:
            first = rows.groupBy(*KEY).agg(F.min("_fill").alias("_fill"))
            whole = written(rows.join(first, [*KEY, "_fill"], "left_semi").drop("_fill"), "answers")
            # The new fill repeats what older ones hold; until they are dropped the older count.
            self.fills.publish({"answers": whole})
            self.fills.drop_older(keep=1)
            dropped(whole)
