"""The language of layers: decorators, annotations and the class machinery."""

from .names import FieldError, GraphError, inherited
from .nodes import Call, code_digest, parameters

# -- annotations ---------------------------------------------------------------------------------------


class Place:
    """Where a parameter's value comes from; a bare name means the usual place of that name."""

    def __init__(self, name):
        self.name = name

    def __repr__(self):
        return f"{type(self).__name__}({self.name!r})"


class Input(Place):
    """The previous layer's field."""


class Output(Place):
    """A field of the same layer."""


class Parameter(Place):
    """A private value of the same layer."""


class InverseInput(Place):
    """A field on the way back, before this layer is undone."""


class InverseOutput(Place):
    """A field on the way back, after this layer is undone."""


class Silent:
    """Leaves a parameter out of digests; wraps a place or a name."""

    def __init__(self, node):
        self.node = node


class AsOutput(Place):
    """The field with the name of the function."""

    def __init__(self):
        super().__init__("")


class _Usual(Place):
    pass


def private(name):
    return name.startswith("_")


# -- functions -----------------------------------------------------------------------------------------


class Function:
    """A function with the places of its arguments: Function(f, 'a', Output('b'), key='c')."""

    def __init__(self, func, *args, **kwargs):
        if not callable(func):
            raise TypeError("Function takes a callable")
        self.func, self.args, self.kwargs = func, args, kwargs

    def places(self, name):
        """([place], names of keyword arguments, positions of silent ones)."""
        keywords = sorted(self.kwargs)
        out, silent = [], []
        for i, a in enumerate([*self.args, *(self.kwargs[k] for k in keywords)]):
            if isinstance(a, Silent):
                silent.append(i)
                a = a.node
            if isinstance(a, str):
                a = _Usual(a)
            if isinstance(a, AsOutput):
                a = _Usual(name)
            if not isinstance(a, Place):
                raise ValueError(f"{a!r} is not the place of an argument")
            out.append(a)
        return out, keywords, silent


def _of_function(func):
    """The Function that a plain function's parameters declare."""
    args = []
    for p in parameters(func):
        place, silent = p.annotation, False
        if isinstance(place, Silent):
            place, silent = place.node, True
        elif place is Silent:
            place, silent = p.name, True
        if isinstance(place, type) and issubclass(place, Place):
            place = place(p.name)
        elif isinstance(place, str) and silent:
            place = _Usual(place)
        elif not isinstance(place, Place):
            place = AsOutput() if p.kind is p.POSITIONAL_ONLY else _Usual(p.name)
        args.append(Silent(place) if silent else place)
    return Function(func, *args)


class Marked:
    """A function or value with marks: inverse, positional, impure, optional, meta, by_value."""

    def __init__(self, inner, *marks, prepare=None):
        self.inner, self.marks, self.prepare = inner, frozenset(marks), prepare

    def __call__(self, *args, **kwargs):
        return self.inner(*args, **kwargs)


def _mark(mark):
    def decorate(value):
        if isinstance(value, Marked):
            if mark in ("positional",):
                raise TypeError("positional must be the lowest of several decorators")
            return Marked(value.inner, *value.marks, mark, prepare=value.prepare)
        if not (callable(value) or isinstance(value, Function)):
            raise TypeError(f"{mark} marks functions")
        return Marked(value, mark)

    decorate.__name__ = mark
    return decorate


inverse, positional, impure, optional, meta = map(_mark, ("inverse", "positional", "impure", "optional", "meta"))


def hash_by_value(func=None, *, prepare=None):
    """The digest of the field is that of its value (or, with prepare, of what prepare makes of its arguments)."""
    if func is None:
        return lambda f: hash_by_value(f, prepare=prepare)
    if isinstance(func, Marked):
        return Marked(func.inner, *func.marks, "by_value", prepare=prepare)
    return Marked(func, "by_value", prepare=prepare)


class Edge:
    """A declared value: kind is output, private, meta or back (a field on the way back)."""

    def __init__(self, kind, name, function, places, keywords=(), silent=(), marks=frozenset(), prepare=None):
        self.kind, self.name, self.function, self.places = kind, name, function, places
        self.keywords, self.silent, self.marks, self.prepare = tuple(keywords), tuple(silent), marks, prepare

    def call(self, nodes):
        """The node of this edge over its arguments' nodes."""
        nodes = tuple(nodes)
        if self.prepare is not None:
            ready = Call(self.prepare, nodes, self.keywords, self.silent, by_value=True)
            return Call(self.function, (ready,), code=code_digest(("prepared", self.function)))
        return Call(self.function, nodes, self.keywords, self.silent, impure="impure" in self.marks, by_value="by_value" in self.marks)


def edge(name, value):
    """The edge that a member `name` of a layer declares."""
    marks, prepare = frozenset(), None
    if isinstance(value, Marked):
        marks, prepare, value = value.marks, value.prepare, value.inner
    if not isinstance(value, Function):
        value = _of_function(value)
    places, keywords, silent = value.places(name)
    kind = "private" if private(name) else "output"
    if "meta" in marks:
        kind = "meta"
    if "positional" in marks:
        if not places:
            raise ValueError("positional needs a function with arguments")
        places = [_Usual(name), *places[1:]]
    if "inverse" in marks:
        if kind != "output":
            raise FieldError(f"{name} can't be inverted")
        kind = "back"
    resolved = []
    for p in places:
        if isinstance(p, _Usual):
            p = Parameter(p.name) if private(p.name) else InverseInput(p.name) if kind == "back" else Input(p.name)
        resolved.append(p)
    return Edge(kind, name, value.func, resolved, keywords, silent, marks, prepare)


class Declaration:
    """What a class (or a mapping of functions) declares."""

    def __init__(self, name, items, allowed=()):
        self.name, self.edges, self.arguments, self.special, self.values = name, [], {}, {}, {}
        annotated = {}
        for key, value in items:
            if key == "__annotations__":
                annotated.update(value)
            elif key in ("__annotate_func__", "__annotate__"):
                annotated.update(value(1) or {})
            elif key in allowed:
                self.special[key] = value
            elif key.startswith("__"):
                if key not in ("__module__", "__qualname__", "__doc__", "__init__", "__firstlineno__", "__static_attributes__", "__classdictcell__", "__conditional_annotations__", "__classcell__"):
                    raise FieldError(f"{key} has no meaning in this layer")
            elif isinstance(value, (staticmethod, classmethod)):
                if private(key):
                    raise FieldError(f"the helper {key} can't be private")
                self.values[key] = value
            elif isinstance(value, property):
                raise FieldError(f"the property {key} is not a field; use meta")
            elif private(key) and not callable(value) and not isinstance(value, (Marked, Function)):
                self.arguments[key[1:]] = (True, value)
            elif isinstance(value, (Marked, Function)) or callable(value):
                self.edges.append(edge(key, value))
            else:
                raise FieldError(f"{key} is neither a function nor private")
        for key in annotated:
            if private(key) and not key.startswith("__"):
                self.arguments.setdefault(key[1:], (False, None))
            elif not private(key):
                raise FieldError(f"the annotated {key} must be private")
        self.inherit = inherited(self.special.get("__inherit__", ()), self.special.get("__exclude__", ()))
        self._check()

    def _check(self):
        seen = set()
        for e in self.edges:
            k = ("back" if e.kind == "back" else "forward", e.name)
            if k in seen:
                raise GraphError(f"multiple definitions of {e.name} in {self.name}")
            seen.add(k)
        if not self.inherit.everything and (both := {e.name for e in self.edges if e.kind in ("output", "meta")} & self.inherit.names):
            raise GraphError(f"{sorted(both)} of {self.name} are both inherited and defined")
        own = {e.name: e for e in self.edges if e.kind != "back"}
        state = {}

        def visit(e):
            if state.get(e.name) == 1:
                raise GraphError(f"{self.name} has a cycle through {e.name}")
            if e.name not in state:
                state[e.name] = 1
                for p in e.places:
                    if isinstance(p, (Output, Parameter)) and p.name in own:
                        visit(own[p.name])
                state[e.name] = 2

        for e in own.values():
            visit(e)

    def bind(self, args, kwargs):
        """Values of the constructor's arguments, by private name."""
        if args:
            if len(args) > 1 or len(self.arguments) != 1:
                raise TypeError(f"{self.name} takes keyword arguments only")
            kwargs = dict(kwargs) | dict(zip(self.arguments, args))
        if odd := set(kwargs) - set(self.arguments):
            raise TypeError(f"{self.name} takes no argument {sorted(odd)}")
        out = {}
        for key, (has, default) in self.arguments.items():
            if key not in kwargs and not has:
                raise TypeError(f"{self.name} needs the argument {key}")
            out["_" + key] = kwargs.get(key, default)
        return out


class Scope(dict):
    """A class body's namespace that keeps several definitions of a name (a field and its inverse)."""

    def __init__(self):
        super().__init__()
        self.pairs = []

    def __setitem__(self, key, value):
        if not key.startswith("__"):
            back = isinstance(value, Marked) and "inverse" in value.marks
            for k, v in self.pairs:
                if k == key and (isinstance(v, Marked) and "inverse" in v.marks) == back:
                    raise TypeError(f"{key} is defined twice")
        self.pairs.append((key, value))
        super().__setitem__(key, value)


class MixinMeta(type):
    def __prepare__(name, bases, **_):
        return Scope()

    def __new__(mcs, name, bases, scope, **flags):
        cls = type.__new__(mcs, name, (), {k: v for k, v in dict(scope).items() if k in ("__module__", "__qualname__", "__doc__")})
        pairs = [(k, v) for k, v in scope.pairs if k not in ("__module__", "__qualname__", "__doc__", "__firstlineno__", "__static_attributes__", "__classdictcell__")]
        for b in bases:
            if hasattr(b, "_mixed"):
                own = {k for k, _ in pairs if not k.startswith("__")}
                if clash := own & {k for k, _ in b._mixed if not k.startswith("__")}:
                    raise RuntimeError(f"{sorted(clash)} are defined more than once in mixins")
                pairs += b._mixed
        if not flags.get("abstract") and bases and not all(hasattr(b, "_mixed") for b in bases):
            raise TypeError("a mixin's bases must be mixins")
        cls._mixed = pairs
        return cls

    def __call__(cls, *args, **kwargs):
        raise RuntimeError("a mixin can't be instantiated")


class LayerMeta(MixinMeta):
    """Makes the Declaration of a layer's class from its body and mixins."""

    def __prepare__(name, bases, **_):
        return Scope()

    def __new__(mcs, name, bases, scope, **flags):
        pairs = scope.pairs if isinstance(scope, Scope) else list(scope.items())
        if flags.get("abstract"):
            cls = type.__new__(mcs, name, bases, dict(scope))
            cls._abstract, cls._allowed = True, flags.get("allowed", ())
            return cls
        mains = [b for b in bases if getattr(b, "_allowed", None) is not None]
        mixins = [b for b in bases if hasattr(b, "_mixed")]
        if len(mains) != 1 and not (not mains and mixins and len(mixins) == len(bases)):
            raise TypeError("a layer is made from one kind of layer, and mixins")
        if len(mains) + len(mixins) != len(bases) or mains and not mains[0]._abstract:
            raise TypeError("a layer's other bases must be mixins")
        for m in mixins:
            own = {k for k, _ in pairs if not k.startswith("__")}
            more = [(k, v) for k, v in m._mixed if not k.startswith("__") or k in ("__annotations__", "__annotate_func__")]
            if clash := own & {k for k, _ in more if not k.startswith("__")}:
                raise RuntimeError(f"{sorted(clash)} are defined more than once in mixins")
            pairs = [*pairs, *more]
        helpers = {k: v for k, v in pairs if isinstance(v, (staticmethod, classmethod))}
        keep = {k: v for k, v in dict(scope).items() if k in ("__module__", "__qualname__", "__doc__", "__classcell__")} | helpers
        cls = type.__new__(mcs, name, tuple(mains), keep)
        cls._abstract = False
        cls._declared = cls._declare(name, pairs)
        cls._scope = dict(scope)
        return cls

    def __call__(cls, *args, **kwargs):
        return type.__call__(cls, *args, **kwargs)


class Mixin(metaclass=MixinMeta, abstract=True):
    """Members for use in several layers: class A(Transform, MyMixin)."""
