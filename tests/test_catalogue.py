"""Every registered query with SQL, against DuckDB on the same tables."""

import duckdb
import pytest

from semdex.plans import catalogue, contracts

QUERIES, SQL = catalogue.queries() | contracts.queries(), catalogue.oracle_sql() | contracts.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return df[cols].astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, duck, sf, name):
    got, want = rows(QUERIES[name](spark, sf).toPandas()), rows(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_path_filter_reaches_the_scan(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from semdex.functions.text import path_contains

    spark.range(10).select(F.concat(F.lit("/a/"), "id").alias("file_path")).write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(path_contains(F.col("file_path"), "a/3"))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(file_path,a/3)" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_a_missing_library_is_no_silence(monkeypatch):
    """Only the absence of the training subpackage leaves its queries out."""
    import builtins

    import __spark_entry__

    real = builtins.__import__

    def without(missing):
        def load(name, *args, **kwargs):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(name, *args, **kwargs)

        return load

    monkeypatch.setattr(builtins, "__import__", without("corpus_pipeline"))
    assert __spark_entry__._training() == []
    monkeypatch.setattr(builtins, "__import__", without("xxhash"))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__._training()
