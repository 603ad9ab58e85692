"""The library's operations as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import text as one
from veilspark.operators.detect import SPANS, as_rows


def register(spark: SparkSession) -> None:
    """pii_detect(text) -> array of spans; pii_redact(text) -> text with <TAG>; pii_restore(text, map) -> text."""
    from veilspark.functions.registry import TAGS

    spans_type = T._parse_datatype_string(SPANS)

    @F.udf(spans_type, useArrow=True)
    def pii_detect(body):
        return as_rows(one.detect(body))

    @F.pandas_udf(T.StringType())
    def pii_redact(bodies):
        def redact(body):
            if body is None:
                return None
            out, at = [], 0
            for s in one.detect(body):
                out += [body[at : s.start], f"<{TAGS.get(s.kind, s.kind)}>"]
                at = s.end
            return "".join([*out, body[at:]])

        return bodies.map(redact, na_action="ignore")

    spark.udf.register("pii_detect", pii_detect)
    spark.udf.register("pii_redact", pii_redact)
    spark.sql(
        r"""CREATE OR REPLACE TEMPORARY FUNCTION pii_restore(body STRING, known MAP<STRING, STRING>) RETURNS STRING
        RETURN aggregate(map_entries(known), body, (acc, e) -> replace(acc, e.key, e.value))"""
    )
