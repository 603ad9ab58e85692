"""Tables written once to the cluster's shared folder, where a plan would compute them again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests, local mode) one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: lineage ends here, and a lost executor costs no recomputation. The folder is emptied by who set it."""
    path = f"{shared_folder(df.sparkSession)}/veilspark-{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_sorted(df: DataFrame, keys: int, function: Callable[[list[tuple]], list[tuple]], schema: str, batch: int = 8192) -> DataFrame:
    """function of the rows of each group, where a partition holds whole groups one after another by the first `keys` columns.

    Groups are read one at a time and written in batches: a frame for each would cost far more than a small group itself."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        rows, out = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), []
        for _, group in groupby(rows, key=lambda row: row[:keys]):
            out += function(list(group))
            while len(out) >= batch:
                yield made(out[:batch])
                out = out[batch:]
        if out:
            yield made(out)

    return df.mapInArrow(run, kind)
