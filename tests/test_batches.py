"""Arrow batches that go to Python workers are bounded by bytes."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import html
from corpusflow.queries import plans, states, texts  # noqa: F401  they register their queries
from corpusflow.queries.registry import QUERIES
from corpusflow.session import BATCH_BYTES, table

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", ["src08_markdown", "src16_extracted", "ret06_ingest"])
def test_query_bounds_its_batches(spark, name):
    spark.conf.unset(BATCH)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(BATCH)) <= BATCH_BYTES


def test_batches_of_long_texts_are_small(spark, tmp_path):
    """A batch of 10,000 rows of 10 kB would be 100 MB in a worker."""
    spark.conf.unset(BATCH)
    spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("<p>0123456</p>"), 700).alias("html")).write.parquet(str(tmp_path / "pages.parquet"))

    @F.pandas_udf("long")
    def together(rows: pd.Series) -> pd.Series:
        return pd.Series([int(rows.str.len().sum())] * len(rows))

    rows = table(spark, str(tmp_path), "pages")
    assert rows.select(F.max(together("html"))).first()[0] < 2 * BATCH_BYTES
    assert rows.select(html.markdown(F.col("html")).alias("m")).where("m = '0123456'").count() == 2000
