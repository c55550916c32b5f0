"""Recency, frequency and monetary scores per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratalake.functions.scalars import as_double, exact_sum
from stratalake.operators.ordering import rank_bucket, with_rank

SCORES = 5
FIGURES = ("recency", "frequency", "monetary")
FIGURE = T.DecimalType(28, 2)  # holds days, counts and money sums exactly


def customer_activity(orders: DataFrame) -> DataFrame:
    """Days since the last order (counted from the day after the last order of all), orders, net total."""
    newest = orders.agg(F.max("fecha_pedido").cast("date")).scalar()
    return (
        orders.filter(F.col("cliente_id").isNotNull())
        .groupBy("cliente_id")
        .agg(
            F.max("fecha_pedido").cast("date").alias("_last"),
            F.count("pedido_id").alias("frequency"),
            exact_sum("total_neto").alias("monetary"),
        )
        .select("cliente_id", F.datediff(F.date_add(newest, 1), "_last").cast("bigint").alias("recency"),
                "frequency", "monetary")
    )


def rfm_scores(orders: DataFrame) -> DataFrame:
    """Activity with three scores from 1 to 5 and their code. Fewer days score higher.

    Scores are fifths of the rank, ties ranked by customer id. The three figures of a customer
    become three rows, so that one range placement by (figure, value, id) ranks all three; every
    figure takes up the same number of ranks. Nothing is ordered in a single task.
    """
    activity = customer_activity(orders)
    figures = [
        F.struct(F.lit(i).alias("_figure"), F.col(name).cast(FIGURE).alias("_value")) for i, name in enumerate(FIGURES)]
    tall = activity.select("cliente_id", F.inline(F.array(*figures)))
    order = [F.col("_figure").asc(), F.col("_value").asc_nulls_last(), F.col("cliente_id").asc()]
    ranked = with_rank(tall, order, "_rank", "_rows")
    customers = (F.col("_rows") / len(FIGURES)).cast("bigint")
    fifth = rank_bucket(F.col("_rank") - F.col("_figure") * customers, customers, SCORES)
    scored = ranked.withColumn("_score", F.when(F.col("_figure") == 0, SCORES + 1 - fifth).otherwise(fifth))

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("_figure") == FIGURES.index(name), F.col(column)))

    return (
        scored.groupBy("cliente_id")
        .agg(
            of("recency", "_value").cast("bigint").alias("recency"),
            of("frequency", "_value").cast("bigint").alias("frequency"),
            as_double(of("monetary", "_value")).alias("monetary"),
            *[of(name, "_score").alias(f"{name}_score") for name in FIGURES],
        )
        .withColumn("rfm_score", F.concat(*[F.col(f"{name}_score").cast("string") for name in FIGURES]))
    )
