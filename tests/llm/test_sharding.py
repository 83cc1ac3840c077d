import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

from lamina.llm import sharding


def test_matrix_margins_and_law():
    rng = np.random.default_rng(1)
    assert sharding.matrix([], [0, 0], 1) == []
    for rows, columns in (([5, 0, 9], [7, 7]), ([3], [1, 1, 1]), ([10**12, 5], [10**12, 5])):
        m = np.array(sharding.matrix(rows, columns, 3), dtype=object)
        assert m.sum(1).tolist() == rows and m.sum(0).tolist() == columns and (m >= 0).all()
    draws = [sharding.hypergeometric(rng, 60, 40, 30) for _ in range(20000)]
    exact = np.random.default_rng(2).hypergeometric(60, 40, 30, 20000)
    assert abs(np.mean(draws) - 18) < 0.1 and abs(np.var(draws) - np.var(exact)) < 0.2
    assert min(draws) >= 0 and max(draws) <= 30


def test_exact_sizes_and_uniform_places(spark):
    df = spark.range(4001, numPartitions=3).withColumn("shard", F.lit(0)).repartition(5)
    out = sharding.shuffle(df, 8, 7).collect()
    assert sorted(r.id for r in out) == list(range(4001))
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append((r.slot, r.id))
    assert sorted(map(len, by.values())) == [500] * 7 + [501]
    for rows in by.values():
        assert sorted(s for s, _ in rows) == list(range(len(rows)))
        ids = [i for _, i in sorted(rows)]
        assert 0.4 < np.mean(np.diff(ids) > 0) < 0.6 and abs(np.mean(ids) - 2000) < 250
    assert {r.id: (r.shard, r.slot) for r in out} != {r.id: (r.shard, r.slot) for r in sharding.shuffle(df, 8, 8).collect()}



def test_rows_of_equal_place_in_files_part(spark):
    """Files of equal size: rows of one index go to shards independently of each other, and shards and slots are uniform."""
    n, files, shards = 1000, 4, 8
    df = spark.range(files * n, numPartitions=files)
    assert [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()] == [n] * files
    out = {r.id: (r.shard, r.slot) for r in sharding.shuffle(df, shards, 3).collect()}
    for a in range(files):
        for b in range(a):
            same = np.mean([out[a * n + k][0] == out[b * n + k][0] for k in range(n)])
            assert abs(same - 1 / shards) < 5 * np.sqrt(1 / shards * (1 - 1 / shards) / n), (a, b, same)
    per = files * n // shards
    table = np.zeros((files * 5, shards * 5))  # fifths of files against fifths of shards
    for i, (shard, slot) in out.items():
        table[i // (n // 5), shard * 5 + slot * 5 // per] += 1
    want = files * n / table.size
    chi, free = ((table - want) ** 2 / want).sum(), (table.shape[0] - 1) * (table.shape[1] - 1)
    assert abs(chi - free) < 5 * np.sqrt(2 * free), (chi, free)


def test_query_columns_and_odd_rows(spark, tmp_path):
    rows = [(1, "é"), (1, "é"), (None, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op2_hypergeometric_shuffle(spark, str(tmp_path))
    got = out.collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert {(r.shard, r.slot, r.law, r.grown_shard) for r in got} == {(s, 0, "rows", None) for s in range(4)}
    assert dict(out.dtypes)["slot"] == "bigint" and dict(out.dtypes)["shard"] == "int"
    assert sharding.shuffle(spark.range(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_columns_without_a_type(spark):
    out = sharding.shuffle(spark.range(20).selectExpr("id", "NULL AS n"), 3)
    assert sorted(r.id for r in out.collect()) == list(range(20)) and out.columns == ["id", "n", "shard", "slot"]
