"""Projections: Transform and Apply."""

from dataclasses import replace

from ..plans.dataset import CallableLayer
from ..plans.declare import Declaration, Function, LayerMeta, Marked
from ..plans.nodes import Call
from ..plans.resolve import transformed


class _Projection(CallableLayer):
    _values = {}

    def connect(self, data):
        return transformed(self._declared, self._values, data)

    def __repr__(self):
        return f"{type(self).__name__}({', '.join(e.name for e in self._declared.edges if e.kind == 'output')})"


class Transform(_Projection, metaclass=LayerMeta, abstract=True, allowed=("__inherit__", "__exclude__")):
    """New fields from those before: a subclass's methods, or functions given by name: Transform(a=f, __inherit__='b')."""

    @classmethod
    def _declare(cls, name, pairs):
        return Declaration(name, pairs, cls._allowed)

    def __init__(self, *args, **kwargs):
        if type(self)._abstract:
            if args:
                raise TypeError("fields are given by name")
            for k, v in kwargs.items():
                if not k.startswith("__") and not (callable(v) or isinstance(v, (Function, Marked))):
                    raise TypeError(f"{k} must be a function")
            self._declared = Declaration("Transform", kwargs.items(), self._allowed)
        else:
            self._values = self._declared.bind(args, kwargs)


class TransformBase(_Projection):
    """A transform from a mapping (or pairs) of names and functions."""

    def __init__(self, items, inherit=(), exclude=()):
        pairs = list(items.items() if isinstance(items, dict) else items)
        self._declared = Declaration(type(self).__name__, [*pairs, ("__inherit__", inherit), ("__exclude__", exclude)], ("__inherit__", "__exclude__"))


class Apply(_Projection):
    """A function of one value for each of some fields; all others stay, on the way back too."""

    def __init__(self, **functions):
        for k, f in functions.items():
            if not callable(f):
                raise TypeError(f"{k} must be a function")
        self._functions = functions

    def connect(self, data):
        out = {n: Call(f, [data.node(n, "Apply")]) for n, f in self._functions.items()}
        back = None if data.back is None else (*data.back, lambda current: current)
        return replace(data, outputs=data.outputs | out, back=back, path=f"{data.path} >> Apply")

    def __repr__(self):
        return f"Apply({', '.join(self._functions)})"
