"""Caches hold what would be computed, follow changes of code and data, and mend what is damaged."""

import glob
import os
import pickle

import pytest
from pyspark.sql import functions as F

from lamina import Apply, CacheColumns, CacheToDisk, CacheToRam, HashDigest, Input, Silent, Source, Transform, hash_by_value, inverse, meta
from lamina.operators.caches import sharded

pytestmark = pytest.mark.usefixtures("spark")


class Many(Source):
    _n = 500

    @meta
    def ids(_n):
        return [str(i) for i in range(_n)]

    def image(i):
        return F.concat(F.lit("image "), i)

    def size(i):
        return F.length(i)


def rows(ds, *names):
    return sorted(ds.to_df(*names).collect())


def files(root):
    return {f for n in ("*", "*/[!_]*") for f in glob.glob(f"{root}/[!.]*/[!.]{n}/*.parquet")}


def test_ram(spark):
    layer = CacheToRam("image", size=2)
    ds = Many() >> Apply(image=F.upper) >> layer
    assert rows(ds) == rows(Many() >> Apply(image=F.upper)) and ds.image("7") == "IMAGE 7" and ds.image("9999") == "IMAGE 9999"
    assert len(layer._cache.frames) == 1
    ds2 = Many() >> Apply(image=F.upper) >> layer
    assert len(layer._cache.frames) == 1  # equal plans share
    Many() >> Apply(image=F.lower) >> layer, Many() >> layer
    assert len(layer._cache.frames) == 2
    layer._clear()
    assert not layer._cache.frames and rows(ds2) == rows(ds)


def test_disk(tmp_path):
    root = f"{tmp_path}/c"
    make = lambda f=F.upper: Many() >> Apply(image=f) >> CacheToDisk.simple("image", root=root)
    want = rows(Many() >> Apply(image=F.upper))
    assert rows(make()) == want
    first = files(root)
    assert rows(make()) == want and files(root) == first
    rows(make(F.lower))
    assert len(files(root)) > len(first)  # another function, another entry
    for f in first:
        os.truncate(f, 10)
    assert rows(make()) == want and not first & files(root)
    assert make().image("7") == "IMAGE 7" and make().size("7") == 1
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    with pytest.raises(FileNotFoundError):
        CacheToDisk.simple(root=f"{tmp_path}/other")
    whole = Many() >> CacheToDisk.simple(root=root, labels={"a": 1})
    assert rows(whole, "image", "size") == rows(Many(), "image", "size")


@pytest.mark.parametrize(("size", "shards"), [(100, 5), (200, 3), (10, 50), (0.5, 2), (0.1, 10), (0.99, 2), (None, 1)])
def test_shards(tmp_path, size, shards):
    ds = Many() >> CacheColumns.simple("image", root=f"{tmp_path}/c", shard_size=size)
    assert rows(ds) == rows(Many())
    assert len({os.path.dirname(f) for f in files(f"{tmp_path}/c")}) == shards
    assert ds.image("7") == "image 7" and (ds >> Transform(__inherit__=True)).image("499") == "image 499"
    with pytest.raises(ValueError):
        ds.image("nothing")
    with pytest.raises(ValueError):
        CacheColumns.simple(root=f"{tmp_path}/c", shard_size=1)


def test_ranks_are_exact_over_ranges(spark, tmp_path):
    frame = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in sharded(frame, 30, f"{tmp_path}/s").select("id", "#shard").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [s for _, s in got] == [k // 30 for k in range(1000)] and len(os.listdir(f"{tmp_path}/s")) > 4


def digests(ds, name="image"):
    return {r["id"]: r[name]["digest"] for r in (ds >> HashDigest(name)).to_df().collect()}


def test_digests(tmp_path):
    ds = Many(n=15)
    step = Transform(image=lambda image: F.upper(image), __inherit__="size")
    want = digests(ds >> step)
    assert len(set(want.values())) == 15
    assert digests(ds >> step >> CacheToRam()) == want == digests(ds >> CacheToDisk.simple("image", root=f"{tmp_path}/d") >> step)
    assert digests(Many(n=15) >> Transform(image=lambda image: F.lower(image))) != want

    def joined(image, size):
        return F.concat(image, size)

    from lamina import Function

    silent = lambda other: Transform(image=Function(joined, "image", Silent(other)))
    more = ds >> Transform(__inherit__=True, more=lambda size: size + 1)
    assert digests(more >> silent("size")) == digests(more >> silent("more"))

    class ByValue(Transform):
        @hash_by_value
        def size(size):
            return size

    class Prepared(Transform):
        @hash_by_value(prepare=lambda image: F.substring(image, 1, 6))
        def image(ready):
            return F.concat(F.lit("received "), ready)

    assert len(set(digests(ds >> ByValue(), "size").values())) == 2


def test_digests_follow_the_table(spark, tmp_path):
    from lamina.functions import is_stable
    from lamina.plans.nodes import code_digest
    from lamina.sources.tables import table_digest

    place = f"{tmp_path}/t"
    spark.range(5).write.parquet(place)
    first = table_digest(spark.read.parquet(place))
    assert table_digest(spark.read.parquet(place)) == first
    spark.range(5000).write.mode("overwrite").parquet(place)
    assert table_digest(spark.read.parquet(place)) != first
    assert table_digest(spark.read.parquet(place).where("id > 1")) != table_digest(spark.read.parquet(place).where("id > 2"))

    nested = f"{tmp_path}/n"
    spark.range(4).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(nested)
    before = table_digest(spark.read.parquet(nested))
    inside = glob.glob(f"{nested}/k=1/*.parquet")[0]
    os.utime(inside, (1, 1))  # rewritten in place, of equal size
    assert table_digest(spark.read.parquet(nested)) != before != table_digest(spark.read.parquet(f"{nested}/k=0"))

    def one(x):
        return x + 1

    def two(x):
        return x + 2

    assert code_digest(one) != code_digest(two)
    two.__qualname__, two.__module__ = one.__qualname__, one.__module__
    assert code_digest(is_stable(one)) == code_digest(is_stable(two))


class Priced(Source):
    _path: str

    def __table__(spark, _path):
        return spark.read.parquet(_path)

    __key__ = "k"

    def price(price):
        return price

    def note(note):
        return note


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_what_ram_holds(spark, tmp_path):
    spark.range(20).selectExpr("id AS k", "id * 1.5 AS price", "'x' AS note", "id AS unused", "id AS other").write.parquet(f"{tmp_path}/t")
    ds = Priced(f"{tmp_path}/t") >> Transform(more=lambda price: price + 1)
    held = (ds >> CacheToRam())._data.base.columns
    assert len(held) == 2 and "id" in held  # ids and one field, no raw column, no digest
    partly = (Priced(f"{tmp_path}/t") >> Transform(more=lambda price: price + 1, __inherit__="note") >> CacheToRam("more"))._data.base.columns
    assert [c for c in partly if c.startswith("#raw:")] == ["#raw:note"]
    class Scaled(Transform):
        def price(price, note):
            return price * F.length(note)

        @inverse
        def price(price, note: Input):
            return price / F.length(note)

    back = Priced(f"{tmp_path}/t") >> Scaled() >> CacheToRam()
    assert sorted(c for c in back._data.base.columns if c.startswith("#raw")) == ["#raw:note"]
    assert sorted(r.price for r in back._wrap(lambda x: x + 2, "price").frame().collect()) == [k * 1.5 + 2 for k in range(20)]
    whole = {r["id"]: r["more"] for r in (ds >> CacheToRam()).to_df().collect()}
    assert whole["3"] == 5.5 and (ds >> CacheToRam()).more("3") == 5.5


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "date"])
def test_lookups_reach_the_scan(spark, tmp_path, kind):
    keys = {"date": "date_add(date'2020-01-01', CAST(id AS int))"}.get(kind, f"CAST(id AS {kind})")
    spark.range(50).selectExpr(f"{keys} AS k", "id * 1.5 AS price", "'x' AS note").write.parquet(f"{tmp_path}/t")
    ds = Priced(f"{tmp_path}/t")
    key = "2020-01-08" if kind == "date" else "7"
    assert ds.price(key) == 10.5
    plan = executed(ds._data.open(key).select("id"))
    assert "EqualTo(k," in plan
    for odd in ("07", "+7", "7.0", "", "x", "99999999999999999999", "-0"):
        with pytest.raises(KeyError):
            ds.price(odd)


def test_a_shard_is_read_alone(spark, tmp_path):
    ds = Many() >> Transform(image=lambda image: image) >> CacheColumns.simple(root=f"{tmp_path}/c", shard_size=50)
    plan = executed(ds._data.open("77"))
    assert "PartitionFilters: [isnotnull(#shard" in plan and ds.image("77") == "image 77"


def test_ids_are_lazy(spark):
    ids = Many(n=12).ids
    assert len(ids) == 12 and "3" in ids and "12" not in ids and ids._found is None
    assert list(ids) == [str(i) for i in range(12)] == list(ids[:]) and ids == tuple(str(i) for i in range(12))


class Upper(Transform):
    __inherit__ = "size"
    _sign = "!"

    def image(image, _sign):
        return F.concat(F.upper(image), F.lit(_sign))


def test_pickled_layers(spark):
    from pyspark import cloudpickle

    from lamina import Chain, Filter, Join, Merge

    ds = Many(n=5) >> Upper(sign="?") >> CacheToRam()
    method = pickle.loads(pickle.dumps(ds.image))
    assert method("3") == "IMAGE 3?" and rows(pickle.loads(pickle.dumps(ds))) == rows(ds)
    more = Chain(ds, Filter(lambda size: size > 0), Apply(image=F.lower))
    assert rows(cloudpickle.loads(cloudpickle.dumps(more))) == rows(more)
    other = Many(n=3) >> Transform(__inherit__="image", length=lambda size: size)
    both = Merge(Join(other >> Transform(__inherit__="image"), other, "image"))
    assert rows(cloudpickle.loads(cloudpickle.dumps(both))) == rows(both)


def test_serializers(tmp_path):
    from lamina import ChainSerializer, JsonSerializer, Serializer

    class OfText(Serializer):
        def fits(self, kind):
            return kind.simpleString() == "string"

        def encode(self, column, kind):
            return F.base64(column.cast("binary"))

        def decode(self, column, kind):
            return F.unbase64(column).cast("string")

    step = Transform(image=lambda image: image, pair=lambda image, size: F.struct(image.alias("a"), F.array(size, F.lit(None)).alias("b")))
    want = sorted(map(str, (Many(n=6) >> step).to_df().collect()))
    for k, serializer in enumerate((JsonSerializer(), ChainSerializer(OfText(), JsonSerializer()))):
        for cache in (CacheToDisk, CacheColumns):
            ds = Many(n=6) >> step >> cache.simple(root=f"{tmp_path}/{k}{cache.__name__}", serializer=serializer)
            assert sorted(map(str, ds.to_df().collect())) == want and ds.image("5") == "image 5"
    with pytest.raises(TypeError):
        Many() >> CacheToDisk.simple(root=f"{tmp_path}/x", serializer=ChainSerializer(OfText()))


def test_batches(spark):
    from lamina import batch

    loads = []

    @batch("double", load=lambda: 10.0)
    def scored(model, size, image):
        assert len(size) == len(image)
        return size * model

    @batch("string")
    def shout(image):
        return image.str.upper()

    ds = Many(n=30) >> Transform(score=scored, image=shout)
    assert ds.score("11") == 20.0 and ds.image("11") == "IMAGE 11" and not loads
    assert digests(Many(n=2) >> Transform(image=shout)) != digests(Many(n=2) >> Transform(image=batch("string")(lambda image: image.str.lower())))
