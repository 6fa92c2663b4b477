"""What a parser is given at once is bounded by rows and bytes."""

import pandas as pd
from pyspark.sql import functions as F

from siltstone.operators import extract


def test_batches_of_a_parser_are_small(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 30)

    @F.pandas_udf("long")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    def largest(n: int, size: int) -> int:
        pages = spark.range(0, n, 1, 1).select(F.repeat(F.lit("a"), size).alias("html"))
        return extract.extract(pages, "html", what="metadata").select(rows("html").alias("rows")).agg(F.max("rows")).first()[0]

    assert largest(3000, 10) <= extract.BATCH_ROWS
    assert largest(200, 100_000) * 100_000 <= 2 * extract.BATCH_BYTES
