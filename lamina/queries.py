"""Registered queries: one or more for each operator over the tables, with their oracle SQL.

Rows are flat: maps of groups are exploded, and sums of doubles rounded, so that any engine can say the same. Operators whose
point is a rule have a query of what each case does: its error, or what it gives.
"""

import datetime
import json
import pickle
import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from . import (
    Apply,
    AsOutput,
    CacheColumns,
    CacheToDisk,
    CacheToRam,
    Chain,
    CheckIds,
    External,
    ExternalBase,
    Filter,
    Function,
    GroupBy,
    HashDigest,
    Input,
    InverseInput,
    InverseOutput,
    Join,
    JsonSerializer,
    Layer,
    LazyChain,
    Merge,
    Mixin,
    Output,
    Parameter,
    Silent,
    Source,
    SourceBase,
    Split,
    Transform,
    TransformBase,
    batch,
    chained,
    hash_by_value,
    impure,
    inverse,
    meta,
    optional,
    positional,
    py,
)
from . import functions as fn

QUERIES, ORACLE_SQL = {}, {}


def query(sql):
    """Registers a query under its function's name with its oracle SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- sources -------------------------------------------------------------------------------------------


class Nation(Source):
    _path: str

    def __table__(spark, _path):
        return spark.read.parquet(f"{_path}/nation.parquet")

    __key__ = "n_nationkey"

    def name(n_name):
        return n_name

    def region(n_regionkey):
        return n_regionkey


class Customer(Source):
    _path: str

    def __table__(spark, _path):
        return spark.read.parquet(f"{_path}/customer.parquet")

    __key__ = "c_custkey"

    def name(c_name):
        return c_name

    def nation(c_nationkey):
        return c_nationkey

    def balance(c_acctbal):
        return c_acctbal

    def segment(c_mktsegment):
        return c_mktsegment


class Orders(Source):
    _path: str

    def __table__(spark, _path):
        return spark.read.parquet(f"{_path}/orders.parquet")

    __key__ = "o_orderkey"

    def status(o_orderstatus):
        return o_orderstatus

    def customer(o_custkey):
        return o_custkey.cast("string")

    def price(o_totalprice):
        return o_totalprice

    def priority(o_orderpriority):
        return o_orderpriority

    def date(o_orderdate):
        return o_orderdate


class Lineitem(Source):
    _path: str

    def __table__(spark, _path):
        return spark.read.parquet(f"{_path}/lineitem.parquet")

    def __key__(l_orderkey, l_linenumber, l_partkey, l_extendedprice):
        return F.concat_ws("-", l_orderkey, l_linenumber, l_partkey, F.round(l_extendedprice * 100).cast("long"))

    def extendedprice(l_extendedprice):
        return l_extendedprice

    def discount(l_discount):
        return l_discount

    def tax(l_tax):
        return l_tax

    def flag(l_returnflag):
        return l_returnflag


LINEITEM_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT))"


class Part(Source):
    _path: str

    def __table__(spark, _path):
        return spark.read.parquet(f"{_path}/part.parquet")

    __key__ = "p_partkey"

    def name(p_name):
        return p_name

    def brand(p_brand):
        return p_brand

    def size(p_size):
        return p_size

    def price(p_retailprice):
        return p_retailprice


class Documents(Source):
    _path: str

    def __table__(spark, _path):
        return spark.read.parquet(f"{_path}/documents.parquet")

    __key__ = "doc_id"

    def text(text):
        return text

    def lang(lang):
        return lang

    def doc_key(doc_id):
        return doc_id.cast("string")


class Labels(Source):
    _path: str

    def __table__(spark, _path):
        return spark.read.parquet(f"{_path}/labels.parquet")

    __key__ = "doc_id"

    def quality(quality):
        return quality

    def toxic(toxic):
        return toxic

    def doc_key(doc_id):
        return doc_id.cast("string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_regionkey AS region FROM nation")
def s1_source(spark, sf_dir):
    return Nation(sf_dir).to_df()


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, upper(s_name) AS name, round(s_acctbal * 2, 2) AS twice FROM supplier")
def s2_source_base(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return SourceBase({"name": lambda s_name: F.upper(s_name), "twice": lambda s_acctbal: F.round(s_acctbal * 2, 2)}, table, "s_suppkey").to_df()


class Keys:
    """An object that an External adapts: ids from the table of regions."""

    def __init__(self, spark, sf_dir):
        self.frame = spark.read.parquet(f"{sf_dir}/region.parquet")

    @property
    def ids(self):
        return self.frame.select(F.col("r_regionkey").cast("string").alias("id"))

    def next(self, id):
        return id.cast("long") + 1

    @classmethod
    def helper(cls):
        return None


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, CAST(r_regionkey + 1 AS BIGINT) AS next, CAST(2 * (r_regionkey + 1) AS BIGINT) AS twice FROM region")
def s3_external(spark, sf_dir):
    return (External(Keys(spark, sf_dir), inputs="id") >> Transform(__inherit__="next", twice=lambda next: next * 2)).to_df()


@query("SELECT CAST(i AS VARCHAR) AS id, 'image ' || i AS image FROM range(20) t(i)")
def s5_listed_ids(spark, sf_dir):
    class Listed(Source):
        _n: int

        @meta
        def ids(_n):
            return [str(i) for i in range(_n)]

        def image(i):
            return F.concat(F.lit("image "), i)

    return Listed(n=20).to_df()


# -- projections ---------------------------------------------------------------------------------------


class Net(Transform):
    _rate = 1.0

    def _net(extendedprice, discount, _rate):
        return extendedprice * (1 - discount) * _rate

    def net_cents(_net):
        return F.floor(_net * 100 + 0.5)

    def taxed_cents(_net, tax):
        return F.floor(_net * (1 + tax) * 100 + 0.5)


@query(f"SELECT {LINEITEM_ID} AS id, CAST(floor(l_extendedprice * (1 - l_discount) * 1.0 * 100 + 0.5) AS BIGINT) AS net_cents, CAST(floor(l_extendedprice * (1 - l_discount) * 1.0 * (1 + l_tax) * 100 + 0.5) AS BIGINT) AS taxed_cents FROM lineitem")
def p1_transform(spark, sf_dir):
    return (Lineitem(sf_dir) >> Net()).to_df()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_size * 2 AS double, p_size + 1 AS more FROM part")
def p2_inline(spark, sf_dir):
    return (Part(sf_dir) >> Transform(double=lambda size: size * 2, more=lambda size: size + 1)).to_df()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_size * 3 AS triple, p_brand AS brand FROM part")
def p3_transform_base(spark, sf_dir):
    return (Part(sf_dir) >> TransformBase({"triple": lambda size: size * 3}, inherit="brand")).to_df()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_name) AS name, c_nationkey AS nation, -c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def p4_apply(spark, sf_dir):
    return (Customer(sf_dir) >> Apply(name=F.upper, balance=lambda x: -x)).to_df()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_nationkey AS nation, length(c_mktsegment) AS size FROM customer")
def p5_inherit(spark, sf_dir):
    return (Customer(sf_dir) >> Transform(__inherit__=["name", "nation"], size=lambda segment: F.length(segment).cast("long"))).to_df()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_nationkey AS nation FROM customer")
def p6_exclude(spark, sf_dir):
    return (Customer(sf_dir) >> Transform(__exclude__=["balance", "segment"])).to_df()


@query(f"SELECT {LINEITEM_ID} AS id, CAST(floor(l_extendedprice * (1 - l_discount) * 0.5 * 100 + 0.5) AS BIGINT) AS net_cents, CAST(floor(l_extendedprice * (1 - l_discount) * 0.5 * (1 + l_tax) * 100 + 0.5) AS BIGINT) AS taxed_cents FROM lineitem")
def p8_arguments(spark, sf_dir):
    return (Lineitem(sf_dir) >> Net(rate=0.5)).to_df()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_size * 2 AS double, p_size * 2 + 1 AS odd FROM part")
def p9_output(spark, sf_dir):
    class Double(Transform):
        def odd(double: Output):
            return double + 1

        def double(size):
            return size * 2

    return (Part(sf_dir) >> Double()).to_df()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_size + p_partkey AS size, round(p_retailprice + p_partkey, 2) AS price FROM part")
def p11_positional(spark, sf_dir):
    def shift(x, id):
        return F.round(x + id.cast("long"), 2)

    class Shift(Transform):
        size = positional(shift)
        price = positional(shift)

    return (Part(sf_dir) >> Shift() >> Apply(size=lambda x: x.cast("long"))).to_df()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand || '/' || p_name AS label FROM part")
def p12_function(spark, sf_dir):
    return (Part(sf_dir) >> Transform(label=Function(lambda a, sep, b: F.concat(a, F.lit("/"), b), "brand", Silent("size"), b="name"))).to_df()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, length(n_name) AS size FROM nation")
def p13_optional(spark, sf_dir):
    class Some(Transform):
        __inherit__ = "name"

        @optional
        def missing(nowhere):
            return nowhere

        @optional
        def size(name):
            return F.length(name).cast("long")

    return (Nation(sf_dir) >> Some() >> Transform(__inherit__=True, more=optional(lambda missing: missing))).to_df()


class SizeMixin(Mixin):
    def _size(name):
        return F.length(name).cast("long")

    def delta(region: Output, _size):
        return _size - region


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_regionkey * 2 AS region, length(n_name) - n_regionkey * 2 AS delta FROM nation")
def p14_mixin(spark, sf_dir):
    class Mixed(Transform, SizeMixin):
        def region(region):
            return region * 2

    return (Nation(sf_dir) >> Mixed()).to_df()


@query("SELECT CAST(count(*) AS BIGINT) AS n, 'half of ' || count(*) AS said FROM nation")
def p15_meta(spark, sf_dir):
    class Sized(Transform):
        __inherit__ = True
        _word: str

        @meta
        def said(ids, _word):
            return f"{_word} {len(ids)}"

    ds = Nation(sf_dir) >> Sized(word="half of")
    return spark.createDataFrame([(len(ds.ids), ds.said)], "n long, said string")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def p17_tuple(spark, sf_dir):
    return Orders(sf_dir)._compile(["status", "price"]).frame()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def p18_instance(spark, sf_dir):
    orders = Orders(sf_dir)
    one = orders(str(spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.min("o_orderkey")).first()[0]))
    return spark.createDataFrame([(one.id, *one["status", "price"])], "id string, status string, price double")


@query("SELECT p_partkey, p_size + 1 AS more, (p_size + 1) * p_partkey AS product FROM part")
def p19_sourceless(spark, sf_dir):
    steps = Transform(__inherit__="p_partkey", more=lambda p_size: p_size + 1) >> Transform(__inherit__=["p_partkey", "more"], product=lambda more, p_partkey: more * p_partkey)
    return steps.apply(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "more", "product")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, substr(n_name, 1, 1) || '#' || length(n_name) AS tag FROM nation")
def u12_python_function(spark, sf_dir):
    return (Nation(sf_dir) >> Transform(tag=py("string")(lambda name: f"{name[0]}#{len(name)}"))).to_df()


# -- filters -------------------------------------------------------------------------------------------


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def f1_filter(spark, sf_dir):
    return (Orders(sf_dir) >> Filter(lambda status, price: (status == "F") & (price > 1000)) >> Transform(__inherit__="price")).to_df()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey <> 0")
def f1_truthy(spark, sf_dir):
    return (Nation(sf_dir) >> Filter(lambda region: region)).to_df()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_custkey IN (1, 3, 5, 700)")
def f2_keep(spark, sf_dir):
    return (Customer(sf_dir) >> Filter.keep(["1", "3", "5", "700"])).to_df("name")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 1 OR c_custkey >= 6000")
def f3_drop(spark, sf_dir):
    return (Customer(sf_dir) >> Filter.drop(str(i) for i in range(0, 6000, 2))).to_df("name")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_regionkey = 1")
def f4_check_ids(spark, sf_dir):
    return (Nation(sf_dir) >> Filter(lambda region: region == 1) >> CheckIds()).to_df("name")


# -- joins ---------------------------------------------------------------------------------------------

_JOIN = """SELECT coalesce(d.k, l.k) AS id, coalesce(d.k, l.k) AS doc_key, d.lang, l.quality, l.toxic
FROM (SELECT CAST(doc_id AS VARCHAR) AS k, lang FROM documents WHERE lang = 'en') d
{} JOIN (SELECT CAST(doc_id AS VARCHAR) AS k, quality, toxic FROM labels WHERE quality = 1) l ON d.k = l.k"""


def _join(sf_dir, how):
    english = Documents(sf_dir) >> Filter(lambda lang: lang == "en") >> Transform(__inherit__=["lang", "doc_key"])
    return Join(english, Labels(sf_dir) >> Filter(lambda quality: quality == 1), "doc_key", how=how).to_df()


@query(_JOIN.format("INNER"))
def j1_inner(spark, sf_dir):
    return _join(sf_dir, "inner")


@query(_JOIN.format("LEFT"))
def j2_left(spark, sf_dir):
    return _join(sf_dir, "left")


@query(_JOIN.format("RIGHT"))
def j3_right(spark, sf_dir):
    return _join(sf_dir, "right")


@query(_JOIN.format("FULL"))
def j4_outer(spark, sf_dir):
    return _join(sf_dir, "OUTER")


def _parts(sf_dir, *fields):
    return Part(sf_dir) >> Transform(__inherit__=fields, brand=lambda brand: brand, key=lambda id: id)


@query("SELECT sha256(unhex(sha256(p_brand)) || unhex(sha256(CAST(p_partkey AS VARCHAR)))) AS id, p_brand AS brand, CAST(p_partkey AS VARCHAR) AS key, p_size AS size, p_retailprice AS price FROM part")
def j6_several_keys(spark, sf_dir):
    return Join(_parts(sf_dir, "size"), _parts(sf_dir, "price"), ["brand", "key"]).to_df()


@query("SELECT p_brand || '@' || p_partkey AS id, p_brand AS brand, CAST(p_partkey AS VARCHAR) AS key, p_size AS size, p_retailprice AS price FROM part")
def j7_to_key(spark, sf_dir):
    return Join(_parts(sf_dir, "size"), _parts(sf_dir, "price"), ["brand", "key"], to_key="@".join).to_df()


@query("""SELECT coalesce(b.k, c.k) AS id, coalesce(b.k, c.k) AS k, a.x, b.y, c.z FROM
(SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS x FROM customer ) a
JOIN ((SELECT CAST(p_partkey AS VARCHAR) AS k, p_name AS y FROM part WHERE p_size > 10) b
FULL JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name AS z FROM supplier) c ON b.k = c.k) ON a.k = coalesce(b.k, c.k)""")
def j11_nested(spark, sf_dir):
    a = Customer(sf_dir) >> Transform(k=lambda id: id, x=lambda name: name)
    b = Part(sf_dir) >> Filter(lambda size: size > 10) >> Transform(k=lambda id: id, y=lambda name: name)
    c = SourceBase({"k": lambda s_suppkey: s_suppkey.cast("string"), "z": lambda s_name: s_name}, spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey")
    return Join(a, Join(b, c, "k", how="outer"), "k").to_df()


# -- groups and parts ----------------------------------------------------------------------------------


@query("SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS member, o_totalprice AS price FROM orders")
def g1_group(spark, sf_dir):
    return (Orders(sf_dir) >> GroupBy("customer")).to_df("price").select("id", F.explode("price").alias("member", "price"))


@query("SELECT sha256(unhex(sha256(o_orderstatus)) || unhex(sha256(o_orderpriority))) AS id, count(*) AS n, min(o_totalprice) AS low FROM orders GROUP BY o_orderstatus, o_orderpriority")
def g2_several(spark, sf_dir):
    grouped = Orders(sf_dir) >> GroupBy(["status", "priority"])
    return (grouped >> Transform(n=Function(fn.count, "price"), low=Function(fn.smallest, "price"))).to_df()


@query("SELECT substr(o_orderpriority, 1, 1) || o_orderstatus AS id, count(*) AS n FROM orders GROUP BY substr(o_orderpriority, 1, 1) || o_orderstatus")
def g3_function(spark, sf_dir):
    grouped = Orders(sf_dir) >> GroupBy(lambda priority, status: F.concat(F.substring(priority, 1, 1), status))
    return (grouped >> Transform(n=lambda price: F.size(price).cast("long"))).to_df()


@query("""SELECT o_orderpriority AS id, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS n,
min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderpriority""")
def g6_reduce(spark, sf_dir):
    class Summary(Transform):
        total = Function(fn.total, "price")
        mean = Function(fn.mean, "price")
        n = Function(fn.count, "price")
        low = Function(fn.smallest, "price")
        high = Function(fn.largest, "price")

    rounded = Apply(total=lambda x: F.round(x, 2), mean=lambda x: F.round(x, 4))
    return (Orders(sf_dir) >> GroupBy("priority") >> Summary() >> rounded).to_df()


class Lines(Split):
    __inherit__ = "lang"

    def __split__(id, text):
        def parts(size):
            return F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.concat_ws("-", id, i).alias("id"), F.struct(x.alias("line"), i.alias("at"), size.alias("size")).alias("context")))

        return F.transform(F.array(F.length(text)), parts)[0]  # the length is counted once a text, and no line carries its whole text

    def line(__part__):
        return __part__["line"]

    def share(__part__):
        """Rounded as doubles are; of an empty text it is 0 / 0, which is an error in ANSI mode."""
        share = F.when(__part__["size"] > 0, F.length(__part__["line"]) / __part__["size"]).otherwise(float("nan"))
        return F.round(share * 1e6) / 1e6


@query("""SELECT doc_id || '-' || i AS id, lang, lines[i + 1] AS line, round(length(lines[i + 1]) / length(text), 6) AS share
FROM (SELECT doc_id, lang, text, string_split(text, chr(10)) AS lines, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)""")
def x1_split(spark, sf_dir):
    return (Documents(sf_dir) >> Lines()).to_df()


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS conversation, role, text FROM conversations")
def x2_group_and_split(spark, sf_dir):
    turns = SourceBase({"conversation": lambda conv_id: conv_id.cast("string"), "role": lambda role: role, "text": lambda text: text}, spark.read.parquet(f"{sf_dir}/conversations.parquet"), lambda conv_id, turn: F.concat_ws("-", conv_id, turn))

    class Turns(Split):
        def __split__(role):
            return F.transform(F.map_keys(role), lambda k: F.struct(k.alias("id"), k.alias("context")))

        def conversation(id):
            return id

        def role(role, __part__):
            return role[__part__]

        def text(text, __part__):
            return text[__part__]

    return (turns >> GroupBy("conversation") >> Turns()).to_df()


# -- unions --------------------------------------------------------------------------------------------


def _named(spark, sf_dir, table, key, **fields):
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumn("key", F.concat(F.lit(f"{table[0]}:"), F.col(key).cast("string")))
    return SourceBase({"source": lambda id: F.lit(table), **fields}, rows, "key")


@query("SELECT 'c:' || c_custkey AS id, c_name AS name, 'customer' AS source FROM customer UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier' FROM supplier")
def u1_merge(spark, sf_dir):
    customers = _named(spark, sf_dir, "customer", "c_custkey", name=lambda c_name: c_name, balance=lambda c_acctbal: c_acctbal)
    return Merge(customers, _named(spark, sf_dir, "supplier", "s_suppkey", name=lambda s_name: s_name)).to_df()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey < 4")
def u2_nested_merge(spark, sf_dir):
    part = lambda k: Nation(sf_dir) >> Filter(lambda region: region == k)
    return Merge(part(0), Merge(part(1), part(2)), part(3)).to_df()


# -- composition ---------------------------------------------------------------------------------------

_CHAIN = "SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_name) || '!' AS name FROM customer WHERE c_acctbal > 0"


def _steps():
    return Filter(lambda balance: balance > 0), Apply(name=F.upper), Transform(name=lambda name: F.concat(name, F.lit("!")))


@query(_CHAIN)
def c1_chain(spark, sf_dir):
    a, b, c = _steps()
    return (Customer(sf_dir) >> a >> b >> c).to_df()


@query(_CHAIN)
def c2_slices(spark, sf_dir):
    a, b, c = _steps()
    whole = Chain(Customer(sf_dir), a, b, c, Apply(name=F.lower))
    return whole[:-1].to_df()


@query(_CHAIN)
def c3_drop_cache(spark, sf_dir):
    a, b, c = _steps()
    return (Customer(sf_dir) >> a >> CacheToRam() >> b >> CacheToRam("name") >> c)._drop_cache().to_df()


@query(_CHAIN)
def c4_lazy(spark, sf_dir):
    a, b, c = _steps()
    return (Customer(sf_dir) >> LazyChain(a, LazyChain(b, c))).to_df()


@query(_CHAIN)
def c5_chained(spark, sf_dir):
    @chained(*_steps())
    class Some(Source):
        _path: str

        def __table__(spark, _path):
            return spark.read.parquet(f"{_path}/customer.parquet")

        __key__ = "c_custkey"

        def name(c_name):
            return c_name

        def balance(c_acctbal):
            return c_acctbal

    return Some(sf_dir).to_df()


# -- caches and digests --------------------------------------------------------------------------------

_NET = ORACLE_SQL["p1_transform"]


@query(_NET)
def k1_ram(spark, sf_dir):
    return (Lineitem(sf_dir) >> Net() >> CacheToRam()).to_df()


def _folder(spark, name="cache"):
    """A folder that executors share: in spark.checkpoint.dir or, for a local session that has none, a new one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{place.rstrip('/')}/{name}" if place else tempfile.mkdtemp(prefix=f"lamina-{name}-")


@query(ORACLE_SQL["p2_inline"])
def k3_disk(spark, sf_dir):
    root = _folder(spark)
    cached = lambda: Part(sf_dir) >> Transform(double=lambda size: size * 2, more=lambda size: size + 1) >> CacheToDisk.simple("double", root=root)
    cached()
    return cached().to_df()


@query(ORACLE_SQL["p2_inline"])
def k5_columns(spark, sf_dir):
    return (Part(sf_dir) >> Transform(double=lambda size: size * 2, more=lambda size: size + 1) >> CacheColumns.simple(root=_folder(spark), shard_size=500)).to_df()


@query("SELECT count(DISTINCT n_nationkey) AS digests, count(*) AS equal FROM nation")
def h1_digest(spark, sf_dir):
    plain = Nation(sf_dir) >> Apply(name=F.upper) >> HashDigest("name")
    other = Nation(sf_dir) >> Apply(name=F.upper) >> CacheToRam() >> CheckIds() >> HashDigest("name")
    both = plain.to_df().withColumnRenamed("name", "a").join(other.to_df().withColumnRenamed("name", "b"), "id")
    return both.agg(F.countDistinct("a.digest").alias("digests"), F.sum((F.col("a.digest") == F.col("b.digest")).cast("long")).alias("equal"))


@query("SELECT count(DISTINCT n_regionkey) AS digests FROM nation")
def h3_by_value(spark, sf_dir):
    class ByRegion(Transform):
        @hash_by_value
        def region(region):
            return region

    return (Nation(sf_dir) >> ByRegion() >> HashDigest("region")).to_df().agg(F.countDistinct("region.digest").alias("digests"))


@query("SELECT CAST(0 AS BIGINT) AS differing, count(*) AS n FROM nation")
def h5_impure(spark, sf_dir):
    class Noise(Transform):
        @impure
        def _noise(id):
            return F.rand() + F.length(id) * 0

        def a(_noise):
            return _noise

        def b(_noise):
            return _noise

    return (Nation(sf_dir) >> Noise()).to_df().agg(F.sum((F.col("a") != F.col("b")).cast("long")).alias("differing"), F.count("*").alias("n"))


# -- inverses ------------------------------------------------------------------------------------------


class Scale(Transform):
    def _top(nation):
        return nation + 1

    def balance(balance, _top):
        return balance / _top

    @inverse
    def guess(guess, _top):
        return F.round(guess * _top, 4)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, round((c_acctbal / (c_nationkey + 1) + 1) * (c_nationkey + 1), 4) AS guess FROM customer")
def i2_inverse(spark, sf_dir):
    return (Customer(sf_dir) >> Scale())._wrap(lambda x: x + 1, "balance", "guess").frame()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, round((c_acctbal / (c_nationkey + 1) + 1) * (c_nationkey + 1), 4) AS guess FROM customer")
def i4_loopback(spark, sf_dir):
    return (Customer(sf_dir) >> Scale() >> Apply(balance=lambda x: x * 1))._loopback(lambda x: x + 1, "balance", "guess").to_df()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, round(c_acctbal * 2 + 1, 2) AS balance FROM customer")
def i3_decorate(spark, sf_dir):
    @(Customer(sf_dir) >> Transform(__inherit__=True))._decorate("balance")
    def twice(balance):
        return F.round(balance * 2 + 1, 2)

    return twice.frame()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal + 10 AS balance, c_nationkey * 2 AS nation FROM customer")
def i5_several(spark, sf_dir):
    class Shift(Transform):
        __inherit__ = True

        def balance(balance):
            return balance + 4

        @inverse
        def balance(balance):
            return balance + 6

    chain = Customer(sf_dir) >> Shift()
    return chain._wrap(lambda balance, nation: (balance, nation * 2), ("balance", "nation")).frame()


@query("SELECT * FROM (VALUES ('apply', 'none'), ('cache', 'none'), ('filter', 'none'), ('group', 'ValueError'), ('merge', 'ValueError')) t(name, error)")
def i6_contexts(spark, sf_dir):
    ds, ask = Nation(sf_dir), lambda chain: lambda: chain._wrap(lambda x: x, "name")
    return _cases(spark, {"apply": ask(ds >> Apply(name=F.upper)), "cache": ask(ds >> CacheToRam()), "filter": ask(ds >> Filter(lambda region: region > 0)), "group": ask(ds >> GroupBy("name") >> Transform(__inherit__=True)), "merge": ask(Merge(ds) >> Transform(__inherit__=True))})


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, '<' || n_name || '>' AS name FROM nation")
def i7_inherited_back(spark, sf_dir):
    chain = Nation(sf_dir) >> Transform(__inherit__="name") >> Transform(__inherit__=True)
    return chain._wrap(lambda name: F.concat(F.lit("<"), name, F.lit(">")), "name").frame()


# -- rules ---------------------------------------------------------------------------------------------


def _cases(spark, cases):
    """One row for each case: the name of the error that its function raises, or `none`."""
    rows = []
    for name, f in cases.items():
        try:
            f()
        except Exception as e:  # noqa: BLE001
            rows.append((name, type(e).__name__))
        else:
            rows.append((name, "none"))
    return spark.createDataFrame(rows, "name string, error string")


def _said(**cases):
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in cases.items()) + ") t(name, error)"


class Regions(ExternalBase):
    """An object that is its own layer."""

    def __init__(self, spark, sf_dir):
        self.frame = spark.read.parquet(f"{sf_dir}/region.parquet")
        super().__init__(inputs="id", properties=["ids"], fields=["tag"])

    @property
    def ids(self):
        return self.frame.select(F.col("r_regionkey").cast("string").alias("id"))

    def tag(self, id):
        return F.concat(F.lit("region "), id)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, 'region ' || r_regionkey AS tag, length('region ' || r_regionkey) AS size FROM region")
def s4_external_base(spark, sf_dir):
    return (Regions(spark, sf_dir) >> Transform(__inherit__="tag", size=lambda tag: F.length(tag).cast("long"))).to_df()


@query(_said(unknown_key="KeyError", unknown_part="ValueError", unknown_joined="KeyError", unknown_group="KeyError", unknown_column="ValueError", unknown_filtered="KeyError"))
def f5_membership(spark, sf_dir):
    ds = Nation(sf_dir)
    pair = Join(ds >> Transform(__inherit__="region", k=lambda id: id), ds >> Transform(k=lambda id: id, other=lambda name: name), "k")
    columns = ds >> CacheColumns.simple("name", root=_folder(spark), shard_size=10)
    layers = {"unknown_key": ds, "unknown_part": Merge(ds >> Filter(lambda region: region == 0)), "unknown_joined": pair >> Transform(name=lambda other: other), "unknown_group": ds >> GroupBy("name"), "unknown_column": columns, "unknown_filtered": ds >> CheckIds()}
    return _cases(spark, {k: (lambda x=x: x.name("none of them")) for k, x in layers.items()})


@query(_said(left="ValueError", right="ValueError", both="none"))
def j5_strict(spark, sf_dir):
    orders = Orders(sf_dir) >> Transform(k=lambda customer: customer, price=lambda price: price)
    customers = Customer(sf_dir) >> Transform(k=lambda id: id, name=lambda name: name)
    other = Customer(sf_dir) >> Transform(k=lambda id: id, balance=lambda balance: balance)
    return _cases(spark, {"left": lambda: Join(orders, customers, "k"), "right": lambda: Join(customers, orders, "k"), "both": lambda: Join(customers, other, "k")})


@query(_said(on_id="ValueError", missing="ValueError", overlap="ValueError", twice="AssertionError", mode="KeyError", number="TypeError"))
def j8_validations(spark, sf_dir):
    a, b = Nation(sf_dir) >> Transform(k=lambda id: id, x=lambda name: name), Nation(sf_dir) >> Transform(k=lambda id: id, y=lambda name: name)
    n = Nation(sf_dir) >> Transform(k=lambda region: region, z=lambda name: name)
    return _cases(spark, {"on_id": lambda: Join(a, b, "id"), "missing": lambda: Join(a, b, "x"), "overlap": lambda: Join(a, a, "k"), "twice": lambda: Join(a, b, ["k", "k"]), "mode": lambda: Join(a, b, "k", how="cross"), "number": lambda: Join(n, n >> Transform(__inherit__="k", w=lambda z: z), "k")})


@query(_JOIN.format("INNER"))
def j9_cached(spark, sf_dir):
    english = Documents(sf_dir) >> Filter(lambda lang: lang == "en") >> Transform(__inherit__=["lang", "doc_key"])
    joined = Join(english, Labels(sf_dir) >> Filter(lambda quality: quality == 1), "doc_key", cache=True)
    joined.to_df().count()
    joined._clear()
    return joined.to_df()


@query(_said(null_key="ValueError", unchecked="none"))
def j10_null_keys(spark, sf_dir):
    a = Nation(sf_dir) >> Transform(k=lambda id, region: F.when(region != 0, id), x=lambda name: name)
    b = Nation(sf_dir) >> Transform(k=lambda id: id, y=lambda name: name)
    return _cases(spark, {"null_key": lambda: Join(a, b, "k"), "unchecked": lambda: Join(a, b, "k", validate=False)})


@query("SELECT CAST(n_nationkey AS VARCHAR) AS member, n_name AS name FROM nation WHERE n_regionkey = 2")
def g4_group_lookup(spark, sf_dir):
    grouped = Nation(sf_dir) >> Transform(__inherit__="name", r=lambda region: region.cast("string")) >> GroupBy("r")
    return spark.createDataFrame(sorted(grouped.name("2").items()), "member string, name string")


@query("SELECT o_orderstatus AS id, count(*) AS n, count(DISTINCT o_orderkey) AS members FROM orders GROUP BY o_orderstatus")
def g5_mapping(spark, sf_dir):
    grouped = Orders(sf_dir) >> Transform(__inherit__="status") >> GroupBy("status")
    return (grouped >> Transform(n=lambda status: F.size(status).cast("long"), members=lambda status: F.size(F.array_distinct(F.map_keys(status))).cast("long"))).to_df()


@query(_said(one_field="RuntimeError", impure="HashError", number="TypeError", missing="DependencyError"))
def g7_errors(spark, sf_dir):
    noisy = Nation(sf_dir) >> Transform(__inherit__=True, noise=impure(lambda id: F.rand() + F.length(id)))
    ds = Nation(sf_dir)
    return _cases(spark, {"one_field": lambda: SourceBase({}, spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey") >> GroupBy("id"), "impure": lambda: noisy >> GroupBy("name"), "number": lambda: ds >> GroupBy("region"), "missing": lambda: ds >> GroupBy("nowhere")})


def _part(__part__):
    return __part__


class Words(Split):
    _sign: str

    def __split__(id, name, _sign):
        return F.transform(F.split(name, " "), lambda x, i: F.struct(F.concat_ws(_sign, id, i).alias("id"), x.alias("word")))

    word = _part

    def of(name):
        return name


@query("SELECT id, word, \"of\" FROM (SELECT n_nationkey || '/' || i AS id, string_split(n_name, ' ')[i + 1] AS word, n_name AS \"of\" FROM (SELECT *, unnest(range(len(string_split(n_name, ' ')))) AS i FROM nation))")
def x3_split_arguments(spark, sf_dir):
    return (Nation(sf_dir) >> Words(sign="/")).to_df()


class Alike(Split):
    def __split__(region):
        return F.array(F.struct(region.cast("string").alias("id"), F.lit(0).alias("context")))

    def name(name):
        return name


@query(_said(twice="AssertionError", unchecked="none", missing="DependencyError", unknown="KeyError"))
def x4_errors(spark, sf_dir):
    ds = Nation(sf_dir)
    return _cases(spark, {"twice": lambda: ds >> Alike(), "unchecked": lambda: ds >> Alike(validate=False), "missing": lambda: ds >> Transform(__inherit__="region") >> Words(sign="/"), "unknown": lambda: (ds >> Words(sign="/")).word("0-0")})


@query("SELECT count(*) AS parts, count(*) AS equal FROM (SELECT unnest(string_split(n_name, ' ')) FROM nation)")
def x5_digest_barrier(spark, sf_dir):
    def same(id, name, _sign):
        return F.arrays_zip(F.transform(F.split(name, " "), lambda x, i: F.concat_ws(_sign, id, i)).alias("id"), F.split(name, " ").alias("word"))

    other = type(Split)("Other", (Split,), {"__annotations__": {"_sign": str}, "__split__": same, "word": _part})
    one, two = ((Nation(sf_dir) >> layer(sign="-") >> HashDigest("word")).to_df() for layer in (Words, other))
    both = one.withColumnRenamed("word", "a").join(two.withColumnRenamed("word", "b"), "id")
    return both.agg(F.count("*").alias("parts"), F.sum((F.col("a.digest") == F.col("b.digest")).cast("long")).alias("equal"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, upper(n_name) AS shout, n_regionkey AS kept FROM nation WHERE n_regionkey < 2")
def u3_optional(spark, sf_dir):
    part = lambda k, **more: Nation(sf_dir) >> Filter(lambda region: region == k) >> Transform(__inherit__="name", shout=optional(lambda name: F.upper(name)), kept=lambda region: region, **more)
    whole = Merge(part(0, lost=optional(lambda nowhere: nowhere)), part(1, lost=optional(lambda region: region)))
    return (whole >> Transform(__inherit__=True, later=optional(lambda lost: lost))).to_df()


@query(_said(overlap="RuntimeError", properties="ValueError", nothing="ValueError", sourceless="ValueError", disjoint="none"))
def u4_errors(spark, sf_dir):
    part = lambda k: Nation(sf_dir) >> Filter(lambda region: region <= k)
    more = Nation(sf_dir) >> Transform(__inherit__=True, other=meta(lambda: 1))
    return _cases(spark, {"overlap": lambda: Merge(part(1), part(2)), "properties": lambda: Merge(part(0), more), "nothing": lambda: Merge(), "sourceless": lambda: Merge(part(0), Apply(name=F.upper)), "disjoint": lambda: Merge(part(1), Nation(sf_dir) >> Filter(lambda region: region > 1))})


class Doubled(Layer):
    """A layer of its own making: it looks at the dataset before and doubles all numeric fields."""

    def connect(self, data):
        numeric = [n for n, kind in data.frame().dtypes if kind in ("bigint", "int", "double")]
        return Apply(**{n: (lambda x: x * 2) for n in numeric}).connect(data)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_regionkey * 2 AS region FROM nation")
def c6_own_layer(spark, sf_dir):
    return (Nation(sf_dir) >> Doubled()).to_df()


@query("SELECT * FROM (VALUES ('pair', 'Nation(id, name, region) >> Apply(name)'), ('chain', 'Chain(Nation(id, name, region), Apply(name), Filter(), CheckIds())'), ('lazy', 'LazyChain(Filter(), Apply(name))'), ('merge', 'Merge(Nation(id, name, region))'), ('group', 'GroupBy(''name'')'), ('digest', 'HashDigest(name, region)')) t(name, text)")
def c7_repr(spark, sf_dir):
    ds = Nation(sf_dir)
    layers = {"pair": ds >> Apply(name=F.upper), "chain": ds >> Apply(name=F.upper) >> Filter(lambda name: name) >> CheckIds(), "lazy": LazyChain(Filter(lambda name: name), Apply(name=F.upper)), "merge": Merge(ds), "group": GroupBy("name"), "digest": HashDigest(["name", "region"])}
    return spark.createDataFrame([(k, repr(v)) for k, v in layers.items()], "name string, text string")


class Shout(Transform):
    __inherit__ = "region"
    _sign = "!"

    def name(name, _sign):
        return F.concat(F.upper(name), F.lit(_sign))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, upper(n_name) || '?' AS name, n_regionkey AS region FROM nation")
def c8_pickled(spark, sf_dir):
    fields = (Nation(sf_dir) >> Shout(sign="?"))._compile(["name", "region"])
    return pickle.loads(pickle.dumps(fields)).frame()


@query("SELECT * FROM (VALUES ('delta'), ('id'), ('ids'), ('region')) t(name)")
def p20_dir(spark, sf_dir):
    class Mixed(Transform, SizeMixin):
        def region(region):
            return region * 2

    return spark.createDataFrame([(n,) for n in dir(Nation(sf_dir) >> Mixed())], "name string")


@query(_said(no_field="AttributeError", no_input="DependencyError", circle="GraphError", both="GraphError", new_id="FieldError", impure_digest="HashError"))
def p21_errors(spark, sf_dir):
    ds, frame = Nation(sf_dir), spark.read.parquet(f"{sf_dir}/nation.parquet")
    noisy = ds >> Transform(noise=impure(lambda id: F.rand() + F.length(id)))
    circle = lambda: TransformBase({"_a": lambda _b: _b, "_b": lambda _a: _a})
    cases = {"no_field": lambda: ds.nowhere, "no_input": lambda: ds >> Transform(x=lambda nowhere: nowhere), "circle": circle, "both": lambda: Transform(__inherit__="name", name=lambda name: name), "new_id": lambda: SourceBase({"id": lambda n_name: n_name}, frame, "n_nationkey"), "impure_digest": lambda: (noisy >> HashDigest("noise")).to_df()}
    return _cases(spark, cases)


class Places(Transform):
    """Every kind of place that an argument can come from."""

    _plus = 3

    def _more(name: Input, _plus: Parameter("_plus")):
        return F.length(name) + _plus

    def size(x: Parameter("_more")):
        return x.cast("long")

    def twice(x: Output("size")):
        return x * 2

    @inverse
    def low(x: InverseInput("twice"), k: Parameter("_more")):
        return x - k

    @inverse
    def lower(x: InverseOutput("low")):
        return x - 1


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, length(n_name) + 3 AS size, (length(n_name) + 3) * 2 AS twice, (length(n_name) + 3) * 2 * 10 - (length(n_name) + 3) - 1 AS lower FROM nation")
def p10_places(spark, sf_dir):
    chain = Nation(sf_dir) >> Places()
    back = chain._wrap(lambda x: x * 10, "twice", "twice", "lower").frame()
    return chain.to_df().join(back, "id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, 2 * n_regionkey + 1 AS odd FROM nation")
def p16_static(spark, sf_dir):
    class Helped(Transform):
        @staticmethod
        def next_odd(x):
            return 2 * x + 1

        def odd(region):
            return Helped.next_odd(region)

    return (Nation(sf_dir) >> Helped()).to_df()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name || '.' AS name FROM nation")
def p11_as_output(spark, sf_dir):
    return (Nation(sf_dir) >> Transform(name=Function(lambda x: F.concat(x, F.lit(".")), AsOutput()))).to_df()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(floor(p_retailprice * p_size * 100 + 0.5) AS BIGINT) AS cents FROM part")
def u13_batches(spark, sf_dir):
    """A model: loaded once a task, and given whole batches."""

    @batch("long", load=lambda: {"factor": 100})
    def cents(model, price, size):
        import numpy as np

        return np.floor(price * size * model["factor"] + 0.5).astype("int64")

    return (Part(sf_dir) >> Transform(cents=cents)).to_df()


# -- rules of caches -----------------------------------------------------------------------------------


def _upper(sf_dir):
    return Nation(sf_dir) >> Apply(name=F.upper)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, upper(n_name) AS name, n_regionkey AS region FROM nation")
def k2_clear(spark, sf_dir):
    layer = CacheToRam("name", size=1)
    cached = _upper(sf_dir) >> layer
    cached.to_df().count()
    layer._clear()
    return cached.to_df()


@query("SELECT * FROM (VALUES ('names', 1, false), ('all', 2, false), ('none of them', 0, true)) t(name, held, same)")
def k6_names(spark, sf_dir):
    ds, rows = _upper(sf_dir), []
    for name, layer in {"names": CacheToRam("name"), "all": CacheToRam(), "none of them": CacheToRam("nam")}.items():
        data = layer.connect(ds._data)
        rows.append((name, sum(type(x).__name__ == "Kept" for x in data.outputs.values()), data is ds._data))
    return spark.createDataFrame(rows, "name string, held int, same boolean")


@query(_said(ram="ValueError", disk="ValueError", allowed="none", other_field="none"))
def k7_guard(spark, sf_dir):
    noisy = Nation(sf_dir) >> Transform(__inherit__="name", noise=impure(lambda id: F.rand() + F.length(id)))
    root = _folder(spark)
    return _cases(spark, {"ram": lambda: noisy >> CacheToRam(), "disk": lambda: noisy >> CacheToDisk.simple(root=root), "allowed": lambda: noisy >> CacheToRam(impure=True), "other_field": lambda: noisy >> CacheToRam("name")})


def _files(spark, root):
    """Data files under a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listed = [], fs.listFiles(where, True)
    while listed.hasNext():
        found.append(listed.next().getPath())
    return fs, [f for f in found if f.getName().endswith(".parquet")]


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, upper(n_name) AS name, n_regionkey AS region FROM nation")
def k8_recovery(spark, sf_dir):
    root = _folder(spark, f"cache-{datetime.datetime.now().timestamp()}")
    (_upper(sf_dir) >> CacheToDisk.simple("name", root=root)).to_df().count()
    fs, files = _files(spark, root)
    for f in files:
        out = fs.create(f, True)
        out.write(bytearray(b"no Parquet"))
        out.close()
    return (_upper(sf_dir) >> CacheToDisk.simple("name", root=root)).to_df()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, upper(n_name) AS name FROM nation")
def k9_writers(spark, sf_dir):
    """Two threads fill one cache; both, and whoever comes later, read whole entries."""
    root = _folder(spark, f"cache-{datetime.datetime.now().timestamp()}")
    make = lambda _: (_upper(sf_dir) >> CacheToDisk.simple("name", root=root)).to_df("name")
    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(make, range(2))
    return first.intersect(second).intersect(make(0))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def k10_interface(spark, sf_dir):
    from .operators.caches import MemoryCache

    class Prefixed(MemoryCache):
        def prepare(self, digest):
            return f"own:{digest}", None

    cache = Prefixed(2)
    cache.raw_set("a", Nation(sf_dir).to_df("name"))
    assert cache.raw_get("b") == (None, False) and list(cache.frames) == ["own:a"]
    return cache.raw_get("a")[0]


@query("SELECT 'owner' AS label, 'someone' AS value")
def k11_labels(spark, sf_dir):
    root = _folder(spark, f"cache-{datetime.datetime.now().timestamp()}")
    _upper(sf_dir) >> CacheToDisk.simple("name", root=root, labels={"owner": "someone"})
    fs, files = _files(spark, root)
    raw = spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(fs.open(spark._jvm.org.apache.hadoop.fs.Path(files[0].getParent(), "_labels.json")))
    return spark.createDataFrame(list(json.loads(bytes(raw)).items()), "label string, value string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, upper(n_name) AS name, n_regionkey AS region FROM nation")
def s8_serializer(spark, sf_dir):
    return (_upper(sf_dir) >> CacheToDisk.simple(root=_folder(spark), serializer=JsonSerializer())).to_df()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_size * 2 AS double FROM part")
def s7_sink(spark, sf_dir):
    path = f"{_folder(spark, 'sink')}/{datetime.datetime.now().timestamp()}"
    (Part(sf_dir) >> Transform(double=lambda size: size * 2)).to_df().write.parquet(path)
    return spark.read.parquet(path)


def _digests(chain, name):
    return (chain >> HashDigest(name)).to_df().select("id", F.col(name)["digest"].alias("digest"))


def _equal(one, two):
    both = one.join(two.withColumnRenamed("digest", "other"), "id")
    return both.agg(F.count("*").alias("n"), F.sum((F.col("digest") == F.col("other")).cast("long")).alias("equal"))


@query("SELECT count(*) AS n, count(*) AS equal FROM nation")
def h4_silent(spark, sf_dir):
    def tag(name, other):
        return F.concat(name, other.cast("string"))

    chain = lambda other: Nation(sf_dir) >> Transform(__inherit__="name", region=lambda region: region, more=lambda region: region + 1) >> Transform(tag=Function(tag, "name", Silent(other)))
    return _equal(_digests(chain("region"), "tag"), _digests(chain("more"), "tag"))


class Dated(Transform):
    _day: datetime.date

    def label(name, _day):
        return F.concat(name, F.lit(f" on {_day}"))


@query("""SELECT kind, day, CAST(n_nationkey AS VARCHAR) AS id, n_name || ' on ' || day AS label
FROM nation, (VALUES ('ram'), ('disk'), ('columns')) k(kind), (VALUES ('2020-01-01'), ('2021-06-30')) d(day)""")
def h6_invalidation(spark, sf_dir):
    """Another argument, another entry: whatever its type."""
    root = _folder(spark)
    caches, out = {"ram": CacheToRam(), "disk": CacheToDisk.simple(root=root), "columns": CacheColumns.simple(root=root, shard_size=7)}, None
    for kind, cache in caches.items():
        for day in (datetime.date(2020, 1, 1), datetime.date(2021, 6, 30)):
            found = (Nation(sf_dir) >> Dated(day=day) >> cache).to_df().withColumns({"kind": F.lit(kind), "day": F.lit(str(day))})
            out = found if out is None else out.unionByName(found)
    return out


@query("SELECT * FROM (VALUES ('stable', true), ('plain', false)) t(name, equal)")
def h7_hints(spark, sf_dir):
    from .plans.digests import code_digest

    def versions(mark):
        for sign in "ab":
            def tag(name, sign=None):
                return F.concat(name, F.lit("."))

            tag.__defaults__ = (sign,)
            yield code_digest(mark(tag))

    return spark.createDataFrame([(name, len(set(versions(mark))) == 1) for name, mark in (("stable", fn.is_stable), ("plain", fn.is_unstable))], "name string, equal boolean")


@query("SELECT count(*) AS n, 64 AS size FROM nation")
def h1_algorithm(spark, sf_dir):
    hashed = (_upper(sf_dir) >> HashDigest("name", algorithm="sha256", return_value=True)).to_df()
    return hashed.where(F.col("name.hash") == F.sha2(F.col("name.digest"), 256)).where("name.value = upper(name.value)").agg(F.count("*").alias("n"), F.max(F.length("name.hash")).alias("size"))
