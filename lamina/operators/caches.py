"""Caches of fields: in memory, in files, and in files cut into shards of sorted keys."""

import json
import uuid
from abc import ABC, abstractmethod
from dataclasses import replace
from math import ceil
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.dataset import Layer, plan_digest, session
from ..plans.names import DependencyError, listed
from ..plans.nodes import Kept, Leaf, Lowering, code_digest, columns_of, projected, quoted, static_digest
from ..sources.tables import exists

MARK = ".lamina-cache"


class Cache(ABC):
    """A store of frames by digest. prepare() makes of a digest what get() and set() take: a key and a context."""

    def prepare(self, digest):
        return digest, None

    def raw_get(self, digest):
        return self.get(*self.prepare(digest))

    def raw_set(self, digest, frame):
        key, context = self.prepare(digest)
        return self.set(key, frame, context)

    @abstractmethod
    def get(self, key, context=None):
        """(frame, True), or (None, False) if there is none."""

    @abstractmethod
    def set(self, key, frame, context=None):
        """Stores a frame and returns it as stored."""


class MemoryCache(Cache):
    """Persisted frames; the longest unused go when there are more than size. Threads may share one."""

    def __init__(self, size=None):
        self.size, self.frames, self._lock = size, {}, Lock()

    def get(self, key, context=None):
        with self._lock:
            if key not in self.frames:
                return None, False
            self.frames[key] = self.frames.pop(key)
            return self.frames[key], True

    def set(self, key, frame, context=None):
        with self._lock:
            if key not in self.frames:
                self.frames[key] = frame.persist(StorageLevel.MEMORY_AND_DISK)
            while self.size is not None and len(self.frames) > self.size:
                self.frames.pop(next(iter(self.frames))).unpersist()
            return self.frames.get(key, frame)

    def clear(self):
        with self._lock:
            while self.frames:
                self.frames.popitem()[1].unpersist()

    def __reduce__(self):
        return type(self), (self.size,)


class ParquetCache(Cache):
    """Parquet under root/<digest>/<version>. A version gets its name when it is complete, and none is ever removed or
    replaced while it can be read: writers at the same time leave one version each, and readers take the first."""

    def __init__(self, root, labels=None):
        self.root, self.labels = str(root).rstrip("/"), labels

    def path(self, digest):
        return f"{self.root}/{digest}"

    def _versions(self, digest):
        spark = session()
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path(digest))
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in names if not n.startswith(".") and exists(f"{self.path(digest)}/{n}/_SUCCESS"))

    def get(self, key, context=None):
        for version in self._versions(key):
            try:
                frame = session().read.parquet(f"{self.path(key)}/{version}")
                frame.limit(1).collect()
                return frame, True
            except Exception:  # a damaged version goes, and is made anew
                _remove(f"{self.path(key)}/{version}")
        return None, False

    def set(self, key, frame, context=None, partition=(), more=()):
        """more: pairs of a name and a frame that are written beside it, under _<name>."""
        spark, version = session(), uuid.uuid4().hex
        own = f"{self.path(key)}/.{version}"
        writer = frame.write.mode("overwrite")
        (writer.partitionBy(*partition) if partition else writer).parquet(own)
        stored = spark.read.parquet(own)
        for name, made in more:
            made(stored).write.parquet(f"{own}/_{name}")
        if self.labels is not None:
            _write_text(f"{own}/_labels.json", json.dumps(self.labels))
        at, to = (spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(key)}/{x}{version}") for x in (".", ""))
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(at, to):
            raise OSError(f"{to.toString()} can't be given its name")
        return spark.read.parquet(f"{self.path(key)}/{version}")


def _remove(path):
    spark = session()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _write_text(path, text):
    spark = session()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


class CacheLayer(Layer):
    """What caches share: which fields they hold, and that none is impure."""

    _is_cache = True

    def __init__(self, names=None, impure=False):
        self.names, self.impure = None if names is None else listed(names, "names"), impure

    def _held(self, data):
        names = [n for n in data.fields() if n != "id" and (self.names is None or n in self.names)]
        impure = [n for n in names if data.outputs[n].is_impure()]
        if impure and not self.impure:
            raise ValueError(f"the field {impure[0]!r} depends on an impure function; impure=True lets it pass the cache")
        return [n for n in names if n not in impure]  # an impure value never equals a stored one

    def connect(self, data):
        if data.base is None:
            return data
        names = self._held(data)
        return self._connected(data, names) if names else data


class CacheToRam(CacheLayer):
    """Keeps fields in Spark's storage memory (and its disk, when memory is short). size: most datasets that this layer keeps."""

    def __init__(self, names=None, *, size=None, impure=False):
        super().__init__(names, impure)
        self._cache = MemoryCache(size)

    def _clear(self):
        """Drops what is kept."""
        self._cache.clear()

    def _connected(self, data, names):
        hidden = {n: f"#kept:{id(self)}:{n}" for n in names}
        outputs = data.outputs | {n: Kept(Leaf(hidden[n]), data.outputs[n]) for n in names}

        def extended(frame):
            low = Lowering(frame)
            cols = {hidden[n]: low.column(data.outputs[n]) for n in names}
            return low.frame.withColumns(cols)

        def narrow(frame):
            """Only what the held fields and their digests, the other fields and the way back are made of."""
            needed = {"id", data.order}.union(*(columns_of(x, d) for x in outputs.values() for d in (False, True)))
            needed = needed.union(*(columns_of(x) for step in data.back or () for x in getattr(step, "nodes", ())))
            return frame.select(*(quoted(c) for c in frame.columns if c in needed))

        digest = code_digest((tuple(plan_digest(data, n) for n in sorted(outputs) if data.has_digest(n)), names, [static_digest(x) for step in data.back or () for x in getattr(step, "nodes", ()) if not x.is_impure()]))
        base, found = self._cache.raw_get(digest)
        if not found:
            base = self._cache.raw_set(digest, narrow(extended(data.base)))

        def opened(key):
            found = base.where(F.col("id") == key)
            return found if found.limit(1).count() else extended(data.open(key))

        return replace(data, outputs=outputs, base=base, open=opened)

    def __repr__(self):
        return f"CacheToRam({self.names or ''})"


class CacheToDisk(CacheLayer):
    """Keeps fields in Parquet files, found again by a digest of functions, arguments and source files in any later session."""

    _unknown = "left"  # an entry that is not stored is made when it is read

    def __init__(self, root, names=None, *, serializer=None, impure=False, labels=None):
        super().__init__(names, impure)
        self.root, self.labels, self.serializer = str(root).rstrip("/"), labels, serializer

    @classmethod
    def simple(cls, *names, root, serializer=None, labels=None):
        """A cache of these fields under root, which is made if it is missing."""
        root = str(root).rstrip("/")
        if exists(root):
            spark = session()
            where = spark._jvm.org.apache.hadoop.fs.Path(root)
            listing = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
            if len(listing) and not exists(f"{root}/{MARK}"):
                raise FileNotFoundError(f"{root} holds something else than a cache")
        _write_text(f"{root}/{MARK}", "1")
        return cls(root, names or None, serializer=serializer, labels=labels)

    def _stored(self, data, names):
        cache = ParquetCache(self.root, self.labels)
        digest = code_digest(("disk", self.serializer, *(plan_digest(data, n) for n in names)))
        found, there = cache.raw_get(digest)
        return found if there else cache.raw_set(digest, self._encoded(data.frame(names)))

    def _encoded(self, frame):
        if self.serializer is None:
            return frame
        kinds = {f.name: f.dataType for f in frame.schema}
        return projected(frame, [("id", F.col("id")), *((n, self.serializer.encode(quoted(n), k)) for n, k in kinds.items() if n != "id")])

    def _at(self, stored, key):
        """The rows of stored with this id."""
        return stored.where(F.col("id") == key)

    def _connected(self, data, names):
        stored = self._stored(data, names)
        hidden = {n: f"#disk:{id(self)}:{n}" for n in names}
        outputs = data.outputs | {n: Kept(Leaf(hidden[n]), data.outputs[n]) for n in names}

        kinds = {f.name: f.dataType for f in data.frame(names).schema} if self.serializer else {}

        def own(frame):
            value = lambda n: self.serializer.decode(quoted(n), kinds[n]) if self.serializer else quoted(n)
            return projected(frame, [("id", F.col("id")), *((h, value(n)) for n, h in hidden.items())])

        whole = set(names) == {n for n in data.fields() if n != "id"} and set().union(*(columns_of(data.outputs[n], True) for n in names)) <= {"id"}
        if whole and not data.back and data.order is None:  # nothing but the files is needed
            return replace(data, outputs=outputs, base=own(stored), open=lambda key: own(self._at(stored, key)))

        def joined(frame, rows, how="left"):
            return frame.join(own(rows).withColumnRenamed("id", "#disk:id"), F.col("id") == F.col("#disk:id"), how).drop("#disk:id")

        return replace(data, outputs=outputs, base=joined(data.base, stored), open=lambda key: joined(data.open(key), self._at(stored, key), self._unknown))

    def __repr__(self):
        return f"{type(self).__name__}({self.names or ''})"


class CacheColumns(CacheToDisk):
    """CacheToDisk in shards of sorted keys: shard_size rows each, or that fraction of all, or (None) one shard.

    Each shard is a folder; the first and last key of each are kept beside them, and reading an entry by its key reads
    the folder of its shard only. Unknown keys: ValueError.
    """

    _unknown = "inner"

    def __init__(self, root, names=None, *, serializer=None, shard_size=None, impure=False, labels=None, verbose=False):
        if shard_size == 1:
            raise ValueError("shard_size is a number of rows over 1, or a fraction under 1")
        super().__init__(root, names, serializer=serializer, impure=impure, labels=labels)
        self.shard_size = shard_size

    @classmethod
    def simple(cls, *names, root, shard_size=None, serializer=None, labels=None):
        made = CacheToDisk.simple(*names, root=root, labels=labels)
        return cls(made.root, names or None, serializer=serializer, shard_size=shard_size, labels=labels)

    def connect(self, data):
        if data.base is None or "id" not in data.outputs:
            raise DependencyError("CacheColumns needs a source")
        return replace(super().connect(data), missing=ValueError)

    def _stored(self, data, names):
        cache = ParquetCache(self.root, self.labels)
        digest = code_digest(("columns", self.shard_size, self.serializer, *(plan_digest(data, n) for n in names)))
        found, there = cache.raw_get(digest)
        if not there:
            bounds = lambda stored: stored.groupBy("#shard").agg(F.min("id").alias("low"), F.max("id").alias("high")).coalesce(1)
            path = f"{self.root}/.sorted-{uuid.uuid4().hex}"
            found = cache.set(digest, sharded(self._encoded(data.frame(names)), self.shard_size, path), None, ["#shard"], [("bounds", bounds)])
            _remove(path)
        return found

    def _at(self, stored, key):
        root = stored._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths().head().toString()
        shard = session().read.parquet(f"{root}/_bounds").where((F.col("low") <= key) & (F.col("high") >= key)).select("#shard").first()
        return stored.where(F.col("id") == key).where(F.col("`#shard`") == (shard[0] if shard else -1))


def sharded(frame, shard_size, path):
    """frame with #shard: the number of each row's shard in the order of ids.

    Rows are written once, sorted, to `path`; a row's rank is its place in its file after the rows of the files before. Of the
    rows nothing comes to the driver but their number.
    """
    frame.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
    rows = session().read.schema(frame.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("#file"), F.col("_metadata.row_index").alias("#row"))
    counts = rows.groupBy("#file").agg(F.count("*").alias("#n"))
    before = Window.orderBy("#file").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each file
    starts = counts.select("#file", F.coalesce(F.sum("#n").over(before), F.lit(0)).alias("#start"))
    size = shard_size
    if not isinstance(size, int):
        total = rows.count()
        size = total if size is None else ceil(size * total)
    placed = rows.join(F.broadcast(starts), "#file")
    return placed.withColumn("#shard", F.floor((F.col("#start") + F.col("#row")) / F.lit(max(1, size))).cast("int")).drop("#file", "#row", "#start")
