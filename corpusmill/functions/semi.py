"""Semi-structured columns: JSON texts as variants, typed values of their paths, and what doesn't fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_typed(rows: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows with a column for each name in ``paths`` (path, type) and ``reject``, why a text gave not all that it holds.

    ``reject`` is null where the text is null or every path has a value of its type or none at all; else it says ``no JSON``
    or names the first path whose value is of another type. The text is parsed once.
    """
    v = F.try_parse_json(F.col(column))
    made = rows.withColumn("_v", v)
    values = {name: F.try_variant_get("_v", path, kind) for name, (path, kind) in paths.items()}
    wrong = F.lit(None).cast("string")
    for name, (path, kind) in reversed(paths.items()):
        raw = F.try_variant_get("_v", path, "variant")
        wrong = F.when(raw.isNotNull() & ~F.is_variant_null(raw) & values[name].isNull(), F.lit(f"{path} is no {kind}")).otherwise(wrong)
    reject = F.when(F.col(column).isNotNull() & F.col("_v").isNull(), "no JSON").otherwise(wrong)
    return made.withColumns(values | {"reject": reject}).drop("_v")


def schema_of(rows: DataFrame, column: str, by: str) -> DataFrame:
    """(by, schema) of the JSON texts together; texts that are no JSON are left out."""
    return rows.groupBy(by).agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("schema"))
