"""Operators that make new rows: Merge, Join, GroupBy and Split."""

import enum
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import REDUCTIONS, hash_array, hash_id
from ..plans.dataset import CallableLayer, Dataset, Fixed, Layer, rows_digest
from ..plans.declare import Declaration, LayerMeta
from ..plans.names import DependencyError, FieldError, HashError, listed
from ..plans.nodes import Leaf, Lowering, as_column, projected, quoted, static_digest
from ..plans.resolve import Forward, function_node


def _data(layer):
    if not isinstance(layer, CallableLayer) or layer._data.base is None:
        raise ValueError("datasets with a source are needed")
    return layer._data


def _repeated(frame, columns):
    """A key of the columns that occurs in several rows, or that is null; None if there is none. Only keys are read."""
    null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns])
    found = frame.groupBy(*(f"`{c}`" for c in columns)).count().where((F.col("count") > 1) | null).limit(1).collect()
    return tuple(found[0][:-1]) if found else None


class Merge(Fixed):
    """The disjoint union of datasets, with the fields that all have. Overlapping ids: RuntimeError.

    validate=False leaves the check of ids out (one job over the ids).
    """

    def __init__(self, *layers, validate=True):
        if not layers:
            raise ValueError("nothing to merge")
        parts = [_data(x) for x in layers]
        names = {tuple(sorted(p.properties)) for p in parts}
        if len(names) != 1 or len(next(iter(names))) != 1:
            raise ValueError(f"merged datasets must have exactly one property, the same one: {sorted(names)}")
        keys = next(iter(names))[0]
        common = [n for n in parts[0].fields() if n != "id" and all(n in p.outputs for p in parts)]
        frames = [p.frame(common, digests=True) for p in parts]
        clean = set.intersection(*(set(f.columns) for f in frames))
        base = reduce(lambda a, b: a.unionByName(b), [f.select(*(quoted(c) for c in f.columns if c in clean)) for f in frames])
        if validate and (twice := _repeated(base.select("id"), ["id"])):
            raise RuntimeError(f"merged datasets have common ids, such as {twice[0]!r}")
        optional = frozenset(n for n in common if all(n in p.optional for p in parts))
        absent = frozenset(n for p in parts for n in p.absent)
        outputs = {"id": Leaf("id")} | {n: Leaf(n, f"#digest:{n}" if f"#digest:{n}" in clean else None, any(p.outputs[n].is_impure() for p in parts)) for n in common}
        self._layers, self._arguments = layers, (layers, {"validate": False})
        self._made = Dataset(outputs, base, lambda key: base.where(F.col("id") == key), persistent=parts[0].persistent, optional=optional, absent=absent, properties={keys: None}, back=None, missing=ValueError, rows=rows_digest(parts[0], "merge", tuple(p.rows for p in parts[1:])), path="Merge", keys=keys)

    def __repr__(self):
        return f"Merge({', '.join(map(repr, self._layers))})"


class JoinMode(enum.Enum):
    inner = "inner"
    left = "left"
    right = "right"
    outer = "full"


class Join(Fixed):
    """A one-to-one join of two datasets on common fields; entries get new ids, by default from the values of `on`.

    Repeated or null keys: ValueError (validate=False leaves the check out, one job over the keys of each side). cache=True
    keeps the joined rows in storage memory until _clear().
    """

    def __init__(self, left, right, on, *, verbose=False, to_key=None, cache=None, how=JoinMode.inner, validate=True):
        if isinstance(how, str):
            how = JoinMode[how.lower()]
        if not isinstance(how, JoinMode):
            raise TypeError(f"how is a JoinMode, not {how!r}")
        on = listed(on, "on")
        if len(set(on)) != len(on):
            raise AssertionError(f"{on} has duplicates")
        l, r = _data(left), _data(right)
        if "id" in on:
            raise ValueError("datasets can't be joined on id; make a field of it")
        for side in (l, r):
            if lost := [k for k in on if k not in side.outputs]:
                raise ValueError(f"the field {lost[0]!r} is not on both sides")
        names = [[n for n in d.fields() if n != "id" and n not in on] for d in (l, r)]
        if both := set(names[0]) & set(names[1]):
            raise ValueError(f"fields {sorted(both)} are on both sides")
        if any(d.outputs[k].is_impure() for d in (l, r) for k in on):
            raise HashError("a join can't depend on an impure field")
        frames = [d.frame([*on, *ns], digests=True).drop("id") for d, ns in zip((l, r), names)]
        if len(on) > 1 or to_key is None:
            for f in frames:
                if odd := [k for k in on if f.schema[k].dataType != T.StringType()]:
                    raise TypeError(f"the field {odd[0]!r} must be a string to be a key")
        if validate:
            for f in frames:
                if twice := _repeated(f, on):
                    raise ValueError(f"the join is not one to one: {dict(zip(on, twice))} is null or occurs several times")
        a, b = frames
        shared = [c for k in on for c in (k, f"#digest:{k}")]
        b = b.select(*(quoted(c).alias(f"#right:{c}") if c in shared else quoted(c) for c in b.columns))
        condition = reduce(lambda x, y: x & y, [quoted(k) == quoted(f"#right:{k}") for k in on])
        joined = a.join(b, condition, how.value)
        values = [F.coalesce(quoted(k), quoted(f"#right:{k}")) for k in on]
        if to_key is None:
            key = hash_id(values)
        elif getattr(to_key, "__name__", "") == "join" and isinstance(getattr(to_key, "__self__", None), str):
            key = F.concat_ws(to_key.__self__, *values)
        else:
            key = as_column(to_key(tuple(values)))
        merged = [F.coalesce(quoted(c), quoted(f"#right:{c}")).alias(c) for c in shared]
        rest = [quoted(c) for c in [*a.columns, *b.columns] if c not in shared and not c.startswith("#right:")]
        base = joined.select(key.alias("id"), *merged, *rest)
        if cache:
            base = base.persist()
        impure = {n for d, ns in zip((l, r), names) for n in ns if d.outputs[n].is_impure()}
        have = set(base.columns)
        fields = [*on, *names[0], *names[1]]
        outputs = {"id": Leaf("id")} | {n: Leaf(n, f"#digest:{n}" if f"#digest:{n}" in have else None, n in impure) for n in fields}
        self._made = Dataset(outputs, base, lambda k: base.where(F.col("id") == k), persistent=frozenset({"id", "ids"}), properties={"ids": None}, back=None, rows=rows_digest(l, "join", r.rows, on, how.value), path="Join", optional=(l.optional | r.optional) & frozenset(fields))
        self._left, self._right, self._on, self._persisted = left, right, on, base if cache else None
        self._arguments = (left, right, on), {"to_key": to_key, "cache": cache, "how": how, "validate": False}

    def _clear(self):
        """Drops what cache=True keeps; later reads join anew."""
        if self._persisted is not None:
            self._persisted.unpersist()

    def __repr__(self):
        return f"Join({self._left!r}, {self._right!r}, on={self._on!r})"


class GroupBy(Layer):
    """Entries by key: every field becomes the map {old id: value} of its group, the keys the new ids.

    by: the name of a field, several, or a function of fields. A map holds its whole group in a row, as it must;
    reductions (lamina.functions: count, total, mean, smallest, largest) that follow are partial aggregates instead.
    """

    def __init__(self, by):
        self.by = by

    def _key(self, data, low):
        if callable(self.by):
            node = function_node(self.by, data, "GroupBy")
            parts = low.value(node)
            nodes = [node]
        else:
            names = listed(self.by, "by")
            nodes = [data.node(n, "GroupBy") for n in names]
            parts = [low.column(n) for n in nodes]
            parts = parts[0] if isinstance(self.by, str) else parts
        if any(n.is_impure() for n in nodes):
            raise HashError("groups can't depend on an impure field")

        def key(part):
            if isinstance(part, (list, tuple)):
                return hash_id([key(p) for p in part])
            kind = low.frame.select(part.alias("c")).schema["c"].dataType
            if kind == T.ArrayType(T.StringType(), True) or kind == T.ArrayType(T.StringType(), False):
                return hash_array(part)
            if kind != T.StringType():
                raise TypeError(f"keys of groups must be strings, not {kind.simpleString()}")
            return part

        return key(parts), code_digests(nodes)

    def connect(self, data):
        if data.base is None:
            raise DependencyError("GroupBy needs a source")
        names = [n for n in data.fields() if n != "id"]
        if not names:
            raise RuntimeError("there is no field to group")
        if any(data.outputs[n].is_impure() for n in names):
            raise HashError("impure fields can't be grouped")
        low = Lowering(data.base)
        key, plan = self._key(data, low)
        cols = [(n, low.column(data.outputs[n])) for n in ["id", *names]] + [(f"#digest:{n}", low.digest(data.outputs[n])) for n in names]
        frame = projected(low.frame, [("#key", key), *cols])
        aggregates = []
        for n in names:
            kind = frame.schema[n].dataType
            entries = F.collect_list(F.struct(F.col("id"), quoted(n).alias("value")))
            entries = F.array_sort(entries) if _ordered(kind) else F.array_sort(entries, lambda x, y: F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0))
            aggregates.append(F.map_from_entries(entries).alias(n))
            aggregates.append(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(F.sha2("id", 256), quoted(f"#digest:{n}")))), ""), 256).alias(f"#digest:{n}"))
            for x in REDUCTIONS:
                if x.name == "count" or isinstance(kind, T.NumericType) or x.name in ("smallest", "largest") and _ordered(kind):
                    aggregates.append(x.aggregate(quoted(n)).alias(f"#{x.name}:{n}"))
        base = frame.groupBy("#key").agg(*aggregates).withColumnRenamed("#key", "id")
        return data.rebased(base, names, missing=KeyError, rows=rows_digest(data, "group", plan), path=f"{data.path} >> GroupBy")

    def __repr__(self):
        return f"GroupBy({self.by!r})"


def code_digests(nodes):
    return tuple(static_digest(n) for n in nodes)


def _ordered(kind):
    if isinstance(kind, T.MapType):
        return False
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    return all(_ordered(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


class Split(CallableLayer, metaclass=LayerMeta, abstract=True, allowed=("__inherit__", "__exclude__", "__split__")):
    """Parts of entries: __split__ (its parameters are fields) gives an array of (part id, context), or a py() function that does.

    Parts have the fields that the methods make from those of the whole entry and, as __part__, the context.
    Repeated part ids: AssertionError (_validate = False leaves the check out, one job over the part ids).
    """

    @classmethod
    def _declare(cls, name, pairs):
        declared = Declaration(name, pairs, cls._allowed)
        if "__split__" not in declared.special:
            raise FieldError("a split needs __split__")
        if any(e.kind in ("meta", "back") for e in declared.edges):
            raise FieldError("a split has neither properties nor inverses")
        return declared

    def __init__(self, *args, **kwargs):
        if type(self)._abstract:
            raise RuntimeError("make a subclass of Split")
        self._values = self._declared.bind(args, {k: v for k, v in kwargs.items() if k != "validate"})
        self._validate = kwargs.get("validate", True)

    def connect(self, data):
        if data.base is None or "id" not in data.outputs:
            raise DependencyError("Split needs a source")
        declared = self._declared
        part = Leaf("#part")
        splitter = Declaration(declared.name, [("split", declared.special["__split__"])])
        splitter.edges += [e for e in declared.edges if e.kind == "private"]
        cut = Forward(splitter, self._values, data)
        try:
            node = cut.own("split")
        except Exception as e:
            raise DependencyError(f"__split__ of {declared.name} lacks a field: {getattr(e, 'name', e)}") from None
        forward = Forward(declared, self._values, data, extra={"__part__": part})
        own, optional, absent = forward.outputs()
        passed = {n: x for n, x in data.outputs.items() if n in declared.inherit and n not in own and n != "id"}
        low = Lowering(data.base)
        array = low.column(node)
        exploded = low.frame.withColumn("#one", F.explode(array))
        first, second = exploded.schema["#one"].dataType.names
        base = exploded.withColumn("#part", F.col("#one")[second]).withColumn("#new", F.col("#one")[first])
        if self._validate and (twice := _repeated(base.select("#new"), ["#new"])):
            raise AssertionError(f"the part id {twice[0]!r} is null or occurs several times")
        new = Lowering(base)
        fields = own | passed
        cols = [(n, new.column(x)) for n, x in fields.items()]
        digests = [(f"#digest:{n}", F.sha2(F.concat_ws("|", F.sha2("#new", 256), new.digest(x)), 256)) for n, x in fields.items() if not x.is_impure()]
        frame = projected(new.frame, [("id", F.col("#new")), *cols, *digests])
        changed = data.rebased(frame, list(fields), missing=KeyError, rows=rows_digest(data, "split", static_digest(node)), path=f"{data.path} >> {declared.name}", optional=frozenset(optional), absent=frozenset(absent))
        impure = {n for n, x in fields.items() if x.is_impure()}
        for n in impure:
            changed.outputs[n] = Leaf(n, None, True)
        return changed


__all__ = ["Merge", "Join", "JoinMode", "GroupBy", "Split"]
