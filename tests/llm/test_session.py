import os

from lamina.llm import session


def test_intermediate_tables_are_written_and_removed(spark):
    df = session.materialize(spark, spark.range(5), "t")
    path = df.inputFiles()[0].replace("file://", "").rpartition("/")[0]
    assert df.count() == 5 and os.path.isdir(path)
    session.clean(spark)
    assert not os.path.exists(path)


def test_only_small_tables_are_broadcast(spark, monkeypatch):
    df = session.materialize(spark, spark.range(5), "t")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(spark.range(3).join(session.small(df), "id"))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1)
    assert "broadcast" not in plan(spark.range(3).join(session.small(df), "id"))


def test_kept_columns_that_clash_are_left_out(spark):
    df = spark.createDataFrame([(1, "t", "u")], "a long, text string, _text string")
    out, name = session.with_text(df, ["a", "text", "_text"], "text", ("a",))
    assert out.columns == ["text", "_text", "__text"] and name == "__text"


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Any

    import pytest

    def session_of(master, folder=None):
        none = Any(isDefined=lambda: False, get=lambda: None)
        return Any(conf=Any(get=lambda key, default: folder), sparkContext=Any(master=master, _jsc=Any(sc=lambda: Any(getCheckpointDir=lambda: none))))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(session_of(master))
        assert session.shared_dir(session_of(master, "s3a://shared/")) == "s3a://shared"


def test_small_tables_are_spread_over_cores(spark, tmp_path):
    spark.range(500).selectExpr("id", "array_join(transform(sequence(1, 300), i -> md5(concat(id, '-', i))), '') AS text").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert df.rdd.getNumPartitions() <= 2 and session.spread(df).rdd.getNumPartitions() == 4
    assert sorted(r.id for r in session.spread(df).select("id").collect()) == list(range(500))
    assert session.spread(spark.range(0)).count() == 0


def test_columns_without_a_type(spark):
    from lamina.llm import pii

    df = spark.createDataFrame([(1, "mail a.b@cd.org"), (2, None)], "doc_id long, text string").selectExpr("NULL AS `a b`", "*", "NULL AS n")
    assert session.materialize(spark, df, "t").dtypes == df.dtypes
    out = pii.replace(df)
    assert out.columns == ["a b", "doc_id", "text", "n", "n_entities"] and out.count() == 2
