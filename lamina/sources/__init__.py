"""Sources: the heads of chains.

A Source over a table names it in __table__(spark, ...) and its key in __key__ (a column's name, or a
function of columns); the parameters of its fields are then columns of the table. A Source without
a table lists its ids, and its fields are functions of the key.
"""

import inspect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.dataset import CallableLayer, Dataset, _called, one_row, session
from ..plans.declare import Declaration, Function, LayerMeta, Marked
from ..plans.names import FieldError, Names
from ..plans.nodes import Argument, ByRow, Call, Leaf, Lowering, code_digest
from ..plans.resolve import Forward
from .tables import table_digest


def _keyed(ids):
    """(base, digest, order) of keys listed on the driver or in a frame with the column id."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col("id").cast("string").alias("id")), table_digest(ids), None
    ids = list(ids)
    if not all(isinstance(i, str) for i in ids):
        raise FieldError("ids must be strings")
    base = session().createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, `#order` long")
    return base, code_digest(tuple(ids)), "#order"


def _at_key(value, column, kind):
    """The condition for one id. For a column of whole numbers, days or strings it is also one of the column itself, in its own
    type, which reaches the scan; what no such value is written as is no id."""
    same = F.col("id") == value
    if isinstance(kind, T.StringType):
        return same & (F.col(f"`#raw:{column}`") == value)
    if isinstance(kind, T.IntegralType) and isinstance(value, str):
        least = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}[kind.simpleString()]
        whole = int(value) if re.fullmatch("0|-?[1-9][0-9]{0,18}", value) else None
        if whole is None or not -(1 << least) <= whole < 1 << least:
            return F.lit(False)
        return same & (F.col(f"`#raw:{column}`") == F.lit(whole).cast(kind))
    if isinstance(kind, T.DateType) and isinstance(value, str) and re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        return same & (F.col(f"`#raw:{column}`") == F.lit(value).cast("date"))
    return same


def _dataset(declared, values):
    table, key = declared.special.get("__table__"), declared.special.get("__key__", "id")
    if any(e.name == "id" for e in declared.edges):
        raise FieldError("a source's id can't be defined anew")
    columns, base, rows, order, opened = set(), None, "", None, None
    if table is not None:
        names = list(inspect.signature(table).parameters)
        frame = table(*(session() if n == "spark" else values[n] for n in names))
        columns = set(frame.columns)
        rows = table_digest(frame)
        if isinstance(key, str):
            key_column = F.col(f"`{key}`")
        else:
            key_column = key(*(F.col(f"`{n}`") for n in inspect.signature(key).parameters))
        base = frame.select(key_column.cast("string").alias("id"), *(F.col(f"`{c}`").alias(f"#raw:{c}") for c in frame.columns))
        kind = frame.schema[key].dataType if isinstance(key, str) else None
        opened = lambda k, base=base: base.where(_at_key(k, key, kind))

    def leaf(name, edge):
        if name in columns and name != "id":
            return Leaf(f"#raw:{name}", ByRow(rows, name))
        keys = {p.name for p in edge.places if type(p).__name__ == "Input" and p.name not in columns}
        if len(keys) > 1:
            raise FieldError(f"{edge.name} has several keys: {sorted(keys)}")
        return Leaf("id")

    forward = Forward(declared, values, None, key=leaf)
    own, optional, _ = forward.outputs()
    metas = forward.metas()
    if table is None:
        if "ids" in metas:
            base, rows, order = _keyed(metas["ids"]())
            opened = lambda k: one_row({"id": k})
    properties = dict(metas) if table is None else {"ids": None} | metas
    if "ids" in properties:
        properties["ids"] = None
    return Dataset({"id": Leaf("id") if base is not None else Argument("id")} | own, base, opened, order, persistent=frozenset({"id", *properties}), optional=frozenset(optional), properties=properties, rows=rows, path=declared.name)


class Source(CallableLayer, metaclass=LayerMeta, abstract=True, allowed=("__table__", "__key__")):
    """A dataset of entries: subclass it and define ids (or __table__) and fields."""

    @classmethod
    def _declare(cls, name, pairs):
        return Declaration(name, pairs, cls._allowed)

    def __init__(self, *args, **kwargs):
        if type(self)._abstract:
            raise RuntimeError("make a subclass of Source")
        self._values = self._declared.bind(args, kwargs)
        self._made = self._dataset()

    def _dataset(self):
        return _dataset(self._declared, self._values)

    def connect(self, data):
        raise TypeError("a source can only be the head of a chain")

    def __repr__(self):
        return f"{type(self).__name__}({', '.join(self._made.fields())})"


class SourceBase(CallableLayer):
    """A source from a mapping (or pairs) of names and functions."""

    def __init__(self, items, table=None, key="id"):
        pairs = list(items.items() if isinstance(items, dict) else items)
        declared = Declaration(type(self).__name__, pairs)
        if table is not None:
            declared.special = {"__table__": lambda: table, "__key__": key}
        self._declared = declared
        self._made = self._dataset()

    def _dataset(self):
        return _dataset(self._declared, {})

    def connect(self, data):
        raise TypeError("a source can only be the head of a chain")


class External(CallableLayer):
    """Any object as a layer: its methods are fields (functions of the columns `inputs`), its properties are properties.

    With a property ids it is a source. marker(name) customises the digest of a field. Attributes are the object's own.
    """

    def __init__(self, obj, *, fields=None, properties=None, inputs, inherit=(), marker=None):
        inputs = (inputs,) if isinstance(inputs, str) else tuple(inputs)
        self._arguments = (obj,), {"fields": fields, "properties": properties, "inputs": inputs, "inherit": inherit, "marker": marker}
        cls, found, props = type(obj), [], []
        for name in dir(cls):
            value = inspect.getattr_static(cls, name)
            if name.startswith("_") or isinstance(value, (classmethod, staticmethod)):
                continue
            if isinstance(value, property):
                props.append(name)
            elif callable(value):
                found.append(name)
        props = props if properties is None else list(properties)
        names = [n for n in (found if fields is None else fields) if n not in props]
        self._obj = obj
        base, rows, order, opened = None, "", None, None
        if "ids" in props:
            base, rows, order = _keyed(getattr(obj, "ids"))
            opened = lambda k: one_row({"id": k})
        nodes = {n: Leaf(n) if base is not None else Argument(n) for n in inputs}
        outputs = {n: Call(getattr(obj, n), [nodes[i] for i in inputs], code=code_digest((marker or (lambda _: cls.__qualname__))(n) if callable(marker) or marker is None else marker) + n) for n in names}
        if base is not None:
            outputs = {"id": Leaf("id")} | outputs
        values = {n: (lambda n=n: getattr(obj, n)) for n in props} | ({"ids": None} if "ids" in props else {})
        self._made = Dataset(outputs, base, opened, order, virtual=Names(inherit), persistent=frozenset({"id", *props}), properties=values, rows=rows, path=cls.__name__)

    def connect(self, data):
        raise TypeError("an external object can only be the head of a chain")

    def __reduce__(self):
        return _called, (type(self), *self._arguments)

    def __getattr__(self, name):
        if name in ("_obj", "_made", "_arguments") or name.startswith("__"):
            raise AttributeError(name)
        if name in self._made.outputs or name in self._made.properties:
            return super().__getattr__(name)
        return getattr(self._obj, name)


class ExternalBase(External):
    """External, by subclassing."""

    def __init__(self, *, fields=None, properties=None, inputs, inherit=(), marker=None):
        super().__init__(self, fields=fields, properties=properties, inputs=inputs, inherit=inherit, marker=marker)

    def __reduce__(self):
        raise TypeError("make the object anew: its constructor is its own")

    def __getattr__(self, name):
        if name.startswith("__") or name in ("_obj", "_made", "_arguments"):
            raise AttributeError(name)
        return CallableLayer.__getattr__(self, name)


__all__ = ["Source", "SourceBase", "External", "ExternalBase", "Function", "Marked", "Lowering"]
