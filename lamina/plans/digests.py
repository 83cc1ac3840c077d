"""Digests of values: functions by their code and all that it refers to, objects by what pickle would keep of them.

A digest is the same in every session, so caches on disk can be found by it. Functions and classes of installed libraries
count by name and code alone, unless is_unstable or unstable_module says that they may change otherwise.
"""

import copyreg
import hashlib
import site
import sys
import sysconfig
import types

from .names import HashError

_PLAIN = (str, bytes, int, float, complex, bool, type(None), type(...))
#: Functions, classes and modules whose whole content counts although they are installed.
_UNSTABLE = set()
_ROOTS = tuple({*(sysconfig.get_paths()[k] for k in ("stdlib", "platstdlib", "purelib", "platlib")), *getattr(site, "getsitepackages", list)()})


def mark_unstable(name):
    _UNSTABLE.add(name)


def _installed(module, qualname):
    """Whether a name is that of an installed library, whose content goes with its version."""
    if module in _UNSTABLE or f"{module}.{qualname}" in _UNSTABLE or "<locals>" in qualname and module == "__main__":
        return False
    if module in sys.builtin_module_names or module == "builtins":
        return True
    path = getattr(sys.modules.get(module), "__file__", None)
    return bool(path) and path.startswith(_ROOTS)


def _names(code):
    """Names that a code object and those inside it use."""
    out = list(code.co_names)
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            out += _names(c)
    return out


class Digester:
    """One digest's memory: every object is looked at once; one that holds itself counts by its place."""

    def __init__(self):
        self.known = {}

    def __call__(self, value):
        kind = type(value)
        if kind in _PLAIN:
            return self._hash(kind.__name__, repr(value))
        if id(value) in self.known:
            return self.known[id(value)][0]
        self.known[id(value)] = (self._hash("cycle", str(len(self.known))), value)  # value is kept, so that no other gets its id
        out = self._of(value, kind)
        self.known[id(value)] = (out, value)
        return out

    @staticmethod
    def _hash(*parts):
        return hashlib.sha256("\0".join(parts).encode("utf-8", "surrogatepass")).hexdigest()

    def _all(self, *values):
        return [self(x) for x in values]

    def _of(self, value, kind):
        if kind in (list, tuple):
            return self._hash(kind.__name__, *self._all(*value))
        if kind in (set, frozenset):
            return self._hash(kind.__name__, *sorted(self._all(*value)))
        if kind in (dict, types.MappingProxyType):
            return self._hash("dict", *sorted(self._hash(*self._all(*kv)) for kv in value.items()))
        if (spark := self._of_spark(value)) is not None:
            return spark
        if not isinstance(value, type) and hasattr(value, "digest_parts"):
            return self(value.digest_parts())
        if kind is types.CodeType:
            return self._hash("code", value.co_code.hex(), *self._all(value.co_names, value.co_varnames, value.co_freevars, value.co_consts, value.co_flags))
        if kind is types.FunctionType:
            return self._function(value)
        if kind is types.MethodType:
            return self._hash("method", *self._all(value.__func__, value.__self__))
        if kind is types.ModuleType:
            return self._hash("module", value.__name__)
        if kind is property:
            return self._hash("property", *self._all(value.fget, value.fset))
        if kind in (staticmethod, classmethod):
            return self._hash(kind.__name__, self(value.__func__))
        if isinstance(value, type):
            return self._class(value)
        return self._object(value)

    def _function(self, f):
        own = [self(f.__code__), self(f.__defaults__), self(f.__kwdefaults__)]
        if _installed(f.__module__ or "", f.__qualname__):
            return self._hash("function", f.__module__, f.__qualname__, *own, *self._cells(f))
        named = {}
        for n in dict.fromkeys(_names(f.__code__)):
            if n in f.__globals__:
                x = named[n] = f.__globals__[n]
                if type(x) is types.ModuleType and not _installed(x.__name__, ""):
                    named |= {f"{n}.{m}": getattr(x, m) for m in _names(f.__code__) if hasattr(x, m)}
        return self._hash("function", *own, *self._cells(f), self(named))

    def _cells(self, f):
        for c in f.__closure__ or ():
            try:
                yield self(c.cell_contents)
            except ValueError:  # a name that has no value yet
                yield "empty"

    def _class(self, cls):
        name = (cls.__module__, cls.__qualname__)
        if _installed(*name):
            return self._hash("class", *name)
        skip = ("__dict__", "__weakref__", "__doc__", "__module__", "__firstlineno__", "__static_attributes__", "_abc_impl", "__annotate__", "__annotate_func__", "__annotations_cache__")
        members = {k: v for k, v in vars(cls).items() if k not in skip and not isinstance(v, (types.GetSetDescriptorType, types.MemberDescriptorType))}
        return self._hash("class", *name, *self._all(members, cls.__bases__))

    def _of_spark(self, value):
        from pyspark.sql import Column, DataFrame, SparkSession

        if isinstance(value, SparkSession):
            return self._hash("session")
        if isinstance(value, Column):
            return self._hash("column", str(value))
        if isinstance(value, DataFrame):
            from ..sources.tables import table_digest

            return self._hash("frame", table_digest(value))
        return None

    def _object(self, value):
        try:
            own = copyreg.dispatch_table.get(type(value))
            made = own(value) if own else value.__reduce_ex__(4)
        except Exception as e:
            raise HashError(f"a value of {type(value).__qualname__} has no digest: {e}") from e
        if isinstance(made, str):
            inner = getattr(value, "__wrapped__", None)
            return self._hash("global", str(getattr(value, "__module__", None) or type(value).__module__), made, *([self(inner)] if inner is not None else ()))
        maker, args, state, items, pairs = (*made, None, None, None)[:5]
        return self._hash("object", *self._all(maker, args, state, list(items or ()), list(pairs or ())))


def code_digest(value):
    """A digest of a function or of any value; HashError if pickle would not keep it either."""
    return Digester()(value)
