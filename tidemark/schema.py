"""Types, constants and checks that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Event types in the order of the funnel; position + 1 is the type's id, 0 an unknown type.
TYPES = ("clicks", "carts", "orders")
TYPE_IDS = {t: i + 1 for i, t in enumerate(TYPES)}
#: Weights of the types in the evaluation metric.
METRIC_WEIGHTS = {"clicks": 0.10, "carts": 0.30, "orders": 0.60}
#: Weights of the types as training targets.
SAMPLE_WEIGHTS = {"clicks": 1.0, "carts": 3.0, "orders": 6.0}
SOURCES = ("popular", "covis", "dssm")
FUSION_WEIGHTS = {"popular": 0.1, "covis": 2.5, "dssm": 0.6}

RAW_SESSION = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("events", T.ArrayType(T.StructType([T.StructField("aid", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("type", T.StringType())]))),
    ]
)
LABELS = T.StructType([T.StructField("session", T.LongType()), T.StructField("type", T.StringType()), T.StructField("labels", T.StringType())])
PREDICTIONS = T.StructType([T.StructField("session", T.LongType()), T.StructField("type", T.StringType()), T.StructField("predictions", T.StringType())])


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...], name: str) -> DataFrame:
    """``df``, or ValueError if a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    return df


def type_id(column: Column | str = "type") -> Column:
    """Id of an event type; 0 for unknown and null ones."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(0)
    for name, i in TYPE_IDS.items():
        out = F.when(c == name, i).otherwise(out)
    return out.cast("int")


def type_value(column: Column | str, values: dict[str, float], default: float = 0.0) -> Column:
    """A constant for each type."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(float(default))
    for name, v in values.items():
        out = F.when(c == name, F.lit(float(v))).otherwise(out)
    return out
