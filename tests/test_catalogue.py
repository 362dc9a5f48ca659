"""Every query against its DuckDB twin on the smallest tables."""

import decimal
import os
import re

import duckdb
import pytest

from tracemill.plans import catalogue, corruptions, generation, manifests  # noqa: F401 (their queries join the catalogue)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return round(float(v), 6) + 0.0 if isinstance(v, (float, decimal.Decimal)) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    twin = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(twin.columns, twin.fetchall())


def moved(df):
    """The columns of each exchange in the plan of ``df``."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [set(re.findall(r"(\w+)#", columns)) for columns in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pairs_move_no_more_than_lines(spark):
    """Pairs are made where their corruptions are: neither steps nor texts move, only the lines and orders that traces are made of."""
    pairs = moved(catalogue.q_pairwise(spark, SF))
    assert any({"l_orderkey", "p_name"} <= columns for columns in pairs)
    assert len(pairs) == len(moved(catalogue.q_corrupt_main(spark, SF)))
    assert not {"steps", "rows", "step_text", "evidence_value", "grounding_ref"} & set().union(*pairs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_profile_moves_one_row_of_a_task(spark):
    """Beside the lines and orders only the partial counts and bounds of the profile move."""
    profile = moved(catalogue.q_qa_profile(spark, SF))
    assert len(profile) == len(moved(catalogue.q_corrupt_main(spark, SF))) + 1
    assert {"count", "min", "max"} in profile
    assert not {"steps", "rows", "step_text", "evidence_value", "grounding_ref"} & set().union(*profile)
