"""Datasets and layers: what a chain of layers knows, and how its fields are read.

A Dataset is immutable: a base DataFrame (its rows are the entries, `id` their keys), the nodes of its
fields, and the rules that say which names go on to the next layer. Without a source the base is
missing and inputs stay open; such a chain is a function of DataFrames (`apply`) or of values.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import DependencyError, FieldError, HashError, Names
from .nodes import Argument, Call, Item, Leaf, Lowering, projected, quoted, static_digest


@dataclass(frozen=True)
class Dataset:
    outputs: dict  # name -> Node
    base: DataFrame | None = None  # one row for each entry
    open: object = None  # key -> base with the entry of that key, whether it is among the ids or not
    order: str | None = None  # column of the base that orders the ids; the id itself by default
    virtual: Names = field(default_factory=Names)
    persistent: frozenset = frozenset()
    optional: frozenset = frozenset()  # names that are there only if what they need is
    absent: frozenset = frozenset()  # optional names that turned out not to be there
    properties: dict = field(default_factory=dict)  # name -> function without arguments
    back: tuple | None = ()  # how layers are undone, first to last; None: not at all
    missing: type = KeyError  # raised for unknown keys
    rows: str = ""  # digest of the plan that chose the rows
    path: str = ""
    keys: str = "ids"  # the property that lists the ids

    def property(self, name):
        """The value of a property; that of `keys` is the sequence of ids."""
        if name == self.keys and self.base is not None and self.properties.get(name) is None:
            return Ids(self.base, self.order)
        return self.properties[name]()

    def node(self, name, layer=""):
        """The node of a field; DependencyError if there is none."""
        if name in self.outputs:
            return self.outputs[name]
        if self.base is None and name in self.virtual:
            return Argument(name)
        raise DependencyError(f"the field {name!r} that {layer or 'a layer'} needs is not in {self.path or 'the chain'}")

    def has(self, name):
        return name in self.outputs or self.base is None and name in self.virtual

    def frame(self, names=None, digests=False, hidden=()):
        """id and the fields `names` (all by default) as columns; with digests also their #digest: columns."""
        if self.base is None:
            raise FieldError("a chain without a source has no rows; use apply()")
        names = [n for n in self.fields() if n != "id"] if names is None else [n for n in names if n != "id"]
        low = Lowering(self.base)
        cols = [(n, low.column(self.outputs[n])) for n in ["id", *names]]
        if digests:
            cols += [(f"#digest:{n}", low.digest(self.outputs[n])) for n in names if self.has_digest(n)]
        return projected(low.frame, [*cols, *((h, quoted(h)) for h in hidden)])

    def has_digest(self, name):
        """Whether a field's values can be told by how they are made; else a digest is that of the value."""
        try:
            return bool(static_digest(self.outputs[name]))
        except HashError:
            return False

    def fields(self):
        return [n for n in self.outputs if n not in self.properties]

    def rebased(self, frame, names, persistent=None, **changes):
        """A Dataset over `frame`, of which the columns are fields and, as #digest: columns, their digests."""
        has = set(frame.columns)
        impure = {n for n in names if n in self.outputs and self.outputs[n].is_impure()}
        outputs = {n: Leaf(n, f"#digest:{n}" if f"#digest:{n}" in has else None, n in impure) for n in ["id", *(x for x in names if x != "id")]}
        return replace(self, **{"outputs": outputs, "base": frame, "open": lambda key: frame.where(F.col("id") == key), "order": None, "virtual": Names(), "back": None, "absent": frozenset(), **changes})


class Ids(Sequence):
    """The ids, in order, as a sequence that reads no more than it must: its length is a count, `in` a lookup, and only
    iteration or an index brings ids to the driver (iteration a partition at a time)."""

    def __init__(self, base, order=None):
        self._base, self._order, self._found = base, order, None

    def _sorted(self):
        order = [F.col(f"`{self._order}`")] if self._order else []
        return self._base.select("id", *order).orderBy(*order, "id").select("id")

    def __len__(self):
        return self._base.count() if self._found is None else len(self._found)

    def __contains__(self, key):
        return self._base.where(F.col("id") == key).limit(1).count() > 0 if self._found is None else key in self._found

    def __iter__(self):
        return iter(self._found) if self._found is not None else (r[0] for r in self._sorted().toLocalIterator())

    def __getitem__(self, index):
        if self._found is None:
            self._found = tuple(self)
        return self._found[index]

    def __eq__(self, other):
        return isinstance(other, (tuple, list, Ids)) and tuple(self) == tuple(other)

    def __hash__(self):
        return hash(tuple(self))

    def __add__(self, other):
        return tuple(self) + tuple(other)

    def __repr__(self):
        return repr(tuple(self))


def session():
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def plain(value):
    """A collected value as plain Python: rows become tuples."""
    if isinstance(value, T.Row):
        return tuple(map(plain, value))
    if isinstance(value, list):
        return [plain(x) for x in value]
    if isinstance(value, dict):
        return {k: plain(value[k]) for k in sorted(value)}
    return bytes(value) if isinstance(value, bytearray) else value


class Method:
    """A compiled field or tuple of fields: called with a key, or with a sourceless chain's inputs."""

    def __init__(self, data, names, layer=None):
        self.data, self.names, self.layer = data, names, layer
        self.many = not isinstance(names, str)
        for n in [names] if not self.many else names:
            if not data.has(n) and n not in data.properties:
                raise FieldError(f"no field {n!r}; there are {sorted(data.outputs)}")
        self.nodes = [data.node(n) for n in ([names] if not self.many else names) if n not in data.properties]
        self.inputs = ["id"] if data.base is not None else sorted(set().union(*(n.inputs() for n in self.nodes)))

    def __reduce__(self):
        """Frames can't be pickled, but the layers that make them can."""
        if self.layer is None:
            raise TypeError("only fields compiled from a layer can be pickled")
        return type(self.layer)._compile, (self.layer, self.names)

    def __call__(self, *args, **kwargs):
        if isinstance(self.names, str) and self.names in self.data.properties:
            return self.data.property(self.names)
        if self.data.base is not None and kwargs and not args:
            args = tuple(kwargs.values())
            kwargs = {}
        values = dict(zip(self.inputs, args)) | kwargs
        if len(args) > len(self.inputs) or set(values) != set(self.inputs):
            raise TypeError(f"the arguments are {', '.join(self.inputs)}")
        if self.data.base is None:
            base = one_row(values)
        else:
            base = self.data.open(values["id"])
        got = self._select(base).limit(2).collect()
        if not got:
            raise self.data.missing(f"{values.get('id')!r} is not in ids")
        return tuple(map(plain, got[0])) if self.many else plain(got[0][0])

    def _select(self, base):
        low = Lowering(base)
        cols = [(f"_{i}", low.column(n)) for i, n in enumerate(self.nodes)]
        return projected(low.frame, cols)

    def frame(self, df=None):
        """The fields for all entries (or, without a source, for the rows of df) as a DataFrame."""
        names = self.names if self.many else [self.names]
        low = Lowering(self.data.base if df is None else df)
        cols = [(x, low.column(n)) for n, x in zip(self.nodes, names)]
        return projected(low.frame, [*([("id", F.col("id"))] if df is None and "id" not in names else []), *cols])


def one_row(values):
    """A frame of one row from Python values; what has no Spark type is given as is and fails there."""
    spark = session()
    if not values:
        return spark.range(1).select(F.lit(None).alias("#none"))
    return spark.createDataFrame([tuple(values.values())], list(values))


class Layer:
    """Something that turns a Dataset into another one."""

    def connect(self, data: Dataset) -> Dataset:
        raise NotImplementedError

    def __repr__(self):
        return f"{type(self).__name__}()"


#: What a chain without source starts from: every name is open.
OPEN = Dataset({}, virtual=Names((), True))


class CallableLayer(Layer):
    """A layer that can be read by itself: a source, a chain, or a transform of open inputs."""

    def _dataset(self) -> Dataset:
        return self.connect(OPEN)

    def __reduce__(self):
        return _remade, (type(self), self.__getstate__())

    @property
    def _data(self):
        if "_made" not in self.__dict__:
            self.__dict__["_made"] = self._dataset()
        return self.__dict__["_made"]

    def __rshift__(self, layer):
        return Chain(self, layer)

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self._data.properties:
            return self._data.property(name)
        try:
            return self._compile(name)
        except FieldError as e:
            raise AttributeError(name) from e

    def __call__(self, *args, **kwargs):
        return Instance(self, args, kwargs)

    def __dir__(self):
        return sorted(self._data.outputs | dict.fromkeys(self._data.properties))

    def _compile(self, names):
        return Method(self._data, names if isinstance(names, str) else tuple(names), self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}  # it is made anew from what declares it

    @property
    def ids_df(self):
        """The ids as a DataFrame; the property ids brings them to the driver."""
        return self._data.base.select("id")

    def to_df(self, *names):
        """id and fields (all by default) of all entries as a DataFrame."""
        for n in names:
            if n not in self._data.outputs:
                raise FieldError(f"no field {n!r}")
        return self._data.frame(names or None)

    def apply(self, df, *names):
        """The fields of a chain without a source, over the rows of df (or of a stream)."""
        data = self._data
        if data.base is not None:
            raise FieldError("this chain has its own source")
        names = names or tuple(data.outputs)
        low = Lowering(df)
        cols = [(n, low.column(data.node(n))) for n in names]
        return projected(low.frame, cols)

    def _wrap(self, func, inputs, outputs=None, final=None):
        return self._decorate(inputs, outputs, final)(func)

    def _decorate(self, inputs, outputs=None, final=None):
        """Runs func between this chain and its way back: a decorator."""
        final = final if final is not None else outputs if outputs is not None else inputs
        return lambda func: Method(self._looped(func, inputs, outputs), final if isinstance(final, str) else tuple(final))

    def _loopback(self, func, inputs, outputs=None):
        """A layer of the fields that come back."""
        return Fixed(self._looped(func, inputs, outputs))

    def _looped(self, func, inputs, outputs=None):
        data = self._data
        single = isinstance(inputs if outputs is None else outputs, str)
        ins = (inputs,) if isinstance(inputs, str) else tuple(inputs)
        outs = ins if outputs is None else (outputs,) if isinstance(outputs, str) else tuple(outputs)
        for names in (ins, outs):
            if len(set(names)) != len(names):
                raise ValueError(f"the names {names} have duplicates")
        if data.back is None:
            raise ValueError("the chain has a layer that is not reversible")
        if lost := [n for n in ins if not data.has(n)]:
            raise FieldError(f"no field {lost[0]!r}")
        whole = Call(func, [data.node(n) for n in ins])
        current = {outs[0]: whole} if single else {n: Item(whole, i, len(outs)) for i, n in enumerate(outs)}
        for step in reversed(data.back):
            current = step(current)
        keep = {"id": data.outputs["id"]} if "id" in data.outputs else {}
        return replace(data, outputs=keep | current, properties={}, virtual=Names(), back=None)


def _remade(cls, state):
    layer = object.__new__(cls)
    layer.__dict__.update(state)
    return layer


class Instance:
    """One entry: its fields by attribute or, several together, by index."""

    def __init__(self, layer, args, kwargs):
        self.__dict__.update(_layer=layer, _args=args, _kwargs=kwargs)

    def __getitem__(self, names):
        return self._layer._compile(names)(*self._args, **self._kwargs)

    def __getattr__(self, name):
        return self[name]

    def __dir__(self):
        return dir(self._layer)


class Fixed(CallableLayer):
    """A layer with a Dataset of its own."""

    def __init__(self, data):
        self._made = data

    def connect(self, data):
        raise TypeError("a dataset can only be the head of a chain")

    def __reduce__(self):
        if "_arguments" not in self.__dict__:
            raise TypeError("only datasets that are declared by layers can be pickled")
        return _called, (type(self), *self._arguments)


def _called(cls, args, kwargs):
    return cls(*args, **kwargs)


class Chain(CallableLayer):
    """Layers, each connected to the one before."""

    def __init__(self, head, *tail):
        if not isinstance(head, Layer) or not all(isinstance(x, Layer) for x in tail):
            raise TypeError("a chain is made of layers")
        layers = []
        for x in (head, *tail):
            layers += x._layers if isinstance(x, (Chain, LazyChain)) else [x]
        self._layers = layers
        self._made = self._dataset()

    def _dataset(self):
        first, *rest = self._layers
        data = first._data if isinstance(first, CallableLayer) else first.connect(OPEN)
        for layer in rest:
            data = layer.connect(data)
        return data

    def connect(self, data):
        for layer in self._layers:
            data = layer.connect(data)
        return data

    def __len__(self):
        return len(self._layers)

    def __getitem__(self, index):
        return Chain(*self._layers[index]) if isinstance(index, slice) else self._layers[index]

    def _filter(self, predicate):
        """The chain of the layers for which predicate is true, in inner chains too."""
        return Chain(*(x for x in self._layers if predicate(x)))

    def _filterfalse(self, predicate):
        return self._filter(lambda x: not predicate(x))

    def _drop_cache(self):
        """The chain without its caches."""
        return self._filterfalse(lambda x: getattr(x, "_is_cache", False))

    def __repr__(self):
        parts = list(map(repr, self._layers))
        return " >> ".join(parts) if len(parts) == 2 else f"Chain({', '.join(parts)})"


class LazyChain(Layer):
    """A chain without a head: connected when it is used in another one."""

    def __init__(self, *layers):
        self._layers = [y for x in layers for y in (x._layers if isinstance(x, (Chain, LazyChain)) else [x])]

    def connect(self, data):
        for layer in self._layers:
            data = layer.connect(data)
        return data

    def __rshift__(self, layer):
        return LazyChain(*self._layers, layer)

    def __repr__(self):
        return f"LazyChain({', '.join(map(repr, self._layers))})"


def chained(*layers, lazy=False):
    """A class decorator: what the class makes is chained with the layers."""

    def decorate(cls):
        def make(*args, **kwargs):
            return (LazyChain if lazy else Chain)(cls(*args, **kwargs), *layers)

        make.__name__ = cls.__name__
        make.__wrapped__ = cls
        return make

    return decorate


def rows_digest(data, *more):
    from .nodes import code_digest

    return code_digest((data.rows, *more))


def plan_digest(data, name):
    """A digest of how a field's values are made."""
    from .nodes import code_digest

    return code_digest((data.rows, name, static_digest(data.outputs[name])))
