"""Evidence rows for a prompt, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a row's text, and the least that a shortened one keeps.
ROW_TEXT, LEAST = 700, 80


def within_budget(rows: DataFrame, by: list, order: str, fields: tuple[str, ...] = ("turn", "text")) -> DataFrame:
    """Rows (by, order, budget, text and what else `fields` names) whose JSON list fits the budget, in order.

    Lengths are those of a JSON list with a space behind each comma and colon. Texts
    are cut to ROW_TEXT first (the feature). The first row of a group always stays,
    its text cut to half the budget if it doesn't fit.
    """
    r = rows.withColumn("text", F.substring("text", 1, ROW_TEXT))
    length = F.length(F.to_json(F.struct(*fields))) + 2 * len(fields) - 1
    w = Window.partitionBy(*by).orderBy(order)
    k = F.row_number().over(w)
    used = F.sum(length).over(w) + 2 * (k - 1) + 2
    r = r.withColumn("_k", k).withColumn("_used", used).where("_used <= budget or _k = 1")
    short = F.expr(f"substring(text, 1, greatest({LEAST}, cast(budget div 2 as int)))")
    return r.withColumn("text", F.when(F.col("_used") <= F.col("budget"), F.col("text")).otherwise(short)).drop("_k", "_used")
