"""Every registered query of the core against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from lamina import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        path = f"{DATA}/{f}" if os.path.isfile(f"{DATA}/{f}") else f"{DATA}/{f}/*.parquet"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) and len(queries.QUERIES) > 50


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_sql(spark, connection, name):
    frame = queries.QUERIES[name](spark, DATA)
    found = connection.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = [dict(zip(columns, r)) for r in found.fetchall()]
    key = lambda r: repr(sorted(r.items()))
    got = sorted(({c: plain(r[c]) for c in columns} for r in frame.collect()), key=key)
    assert got == sorted(({c: plain(v) for c, v in r.items()} for r in want), key=key)


def test_lines_of_odd_texts(spark, tmp_path):
    """Empty texts, which have 0 / 0 as their line's share, and shares halfway between two roundings."""
    texts = ["", None, "\n", "a\r\n\nb", "é\n\U0001f600"] + ["\n".join(("x" * k, "y" * (639 - k))) for k in range(0, 640, 3)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = c.execute(f"SELECT id, lang, line, share FROM ({queries.ORACLE_SQL['x1_split']})").fetchall()
    got = queries.x1_split(spark, str(tmp_path)).select("id", "lang", "line", "share").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert "('0-0', 'en', '', nan)" in map(repr, want)


def test_lines_do_not_carry_their_text(spark):
    """A row of a line that holds the whole text makes a long text cost its length times its lines."""
    plan = queries.x1_split(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate ")]
    assert "raw:text" not in above and "raw:text" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
