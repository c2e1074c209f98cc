"""Every registered engine query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from heaploom import operator_queries, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


ALL = queries.QUERIES | operator_queries.QUERIES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, con, name):
    df = ALL[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in res.fetchall())


def test_timeline_with_many_samples(spark):
    from pyspark.sql import functions as F

    from heaploom.operators.grouping import timeline

    nodes = spark.range(1, 1001).select("id", F.lit(2).cast("long").alias("self_size"))
    samples = spark.range(1, 201).select(F.col("id").alias("seq"), F.col("id").alias("timestamp_us"), F.when(F.col("id") == 50, 3).otherwise(F.col("id") * 4).cast("long").alias("last_assigned_id"))
    got = {r["seq"]: (r["id_from"], r["id_to"], r["count"], r["size"]) for r in timeline(nodes, samples).collect()}
    assert len(got) == 200 and got[1] == (0, 4, 4, 8) and got[200] == (796, 800, 4, 8)
    # ids that step back do not open what was counted before
    assert got[50] == (196, 3, 0, 0) and got[51] == (3, 204, 8, 16)
    assert sum(c for _, _, c, _ in got.values()) == 800


def test_registry():
    found = entry.queries()
    assert set(ALL) <= set(found) and set(entry.oracle_sql()) <= set(found)
