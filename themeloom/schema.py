"""Column contracts shared by every source and stage."""

from pyspark.sql import types as T

UNIFIED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("author_hash", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

ACTION = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField("effort", T.StringType()),
        T.StructField("rationale", T.StringType()),
    ]
)

ANNOTATION = T.StructType(
    [
        T.StructField("theme_name", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("root_causes", T.ArrayType(T.StringType())),
        T.StructField("severity", T.IntegerType()),
        T.StructField("severity_rationale", T.StringType()),
        T.StructField("recommended_actions", T.ArrayType(ACTION)),
        T.StructField("evidence_quote_ids", T.ArrayType(T.StringType())),
    ]
)

EFFORTS = ("low", "medium", "high")
NOISE = -1
