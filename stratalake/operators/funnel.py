"""Conversion funnel over event types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stratalake.functions.scalars import ratio
from stratalake.settings import FUNNEL_STEPS


def conversion_funnel(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """Events per step in step order, and the relative change to the previous present step.

    Other event types are dropped at the scan, so the window sees one row per step.
    """
    counts = events.filter(F.col("tipo_evento").isin(*steps)).groupBy("tipo_evento").agg(
        F.count("evento_id").alias("total_eventos"))
    position = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("tipo_evento"))
    by_step = Window.orderBy("_step")
    previous = F.lag("total_eventos").over(by_step)
    change = ratio(F.col("total_eventos") - previous, previous)
    return (
        counts.withColumn("_step", position)
        .withColumn("conversion_rate", F.coalesce(F.round(change, 4), F.lit(0.0)))
        .orderBy("_step")
        .select("tipo_evento", "total_eventos", "conversion_rate")
    )
