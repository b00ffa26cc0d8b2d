"""Row shapes shared by the readers, the index and the search plans."""

from __future__ import annotations

from pyspark.sql import types as T

QUESTION_FIELD = "question"
TOPIC_FIELD = "topic"
FIELDS = (QUESTION_FIELD, TOPIC_FIELD)

QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("ord", T.LongType()),
    ]
)
