"""What a memory item must fulfil, checked before it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.functions import text


def problem(memory_layer: Column, importance: Column, content: Column) -> Column:
    """The first constraint an item breaks, or null: layer name, importance in [0, 1], content."""
    return (F.when(~F.coalesce(memory_layer.isin(*K.LAYERS), F.lit(False)), "memory_layer")
            .when(~F.coalesce(importance.between(0.0, 1.0), F.lit(False)), "importance")
            .when(text.is_blank(content), "content"))


def checked(rows: DataFrame) -> DataFrame:
    """Add ``problem`` to rows with memory_layer, importance and content."""
    return rows.withColumn("problem", problem(F.col("memory_layer"), F.col("importance"), F.col("content")))
