import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from sorakana.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]

    def clean(x):
        if not isinstance(x, (list, tuple, dict)) and (x is None or pd.isna(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(frame.columns), Counter(tuple(map(clean, r)) for r in frame.astype(object).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(c.execute(ORACLES[name]).fetchdf())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_every_document_is_tokenized(spark):
    assert entry.queries()["tokenize_corpus"](spark, SF).select("text_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
