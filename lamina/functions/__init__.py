"""Functions for fields: plain Python as a UDF, reductions of groups, and key digests."""

import functools
import inspect

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.digests import mark_unstable


def py(returns, arrow=True):
    """Marks a plain Python function: it becomes a UDF with this return type. Its batches travel by Arrow.

    Generators give lists. Use it only where no Column function says the same.
    """

    def decorate(func):
        @functools.wraps(func)
        def call(*args, **kwargs):
            columns = [a if isinstance(a, Column) else F.lit(a) for a in args]
            names = sorted(kwargs)

            def run(*values):
                k = len(values) - len(names)
                out = func(*values[:k], **dict(zip(names, values[k:])))
                return list(out) if hasattr(out, "__next__") else out

            made = F.udf(run, returns, useArrow=arrow)
            return made(*columns, *(kwargs[n] for n in names))

        call.digest_parts = lambda: ("py", str(returns), func)
        return call

    return decorate


def batch(returns, load=None):
    """Marks a function of whole batches: it gets pandas Series (or frames, for structs) and returns one, by an Arrow-batched
    UDF, so nothing is done row by row. With load, a function without arguments such as one that reads a model, its result is the
    first argument; it is loaded once for each task, not for each batch."""

    def decorate(func):
        from collections.abc import Iterator

        import pandas as pd

        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            first = () if load is None else (load(),)
            for series in batches:
                yield func(*first, *series)

        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return run((series,) for series in batches)

        @functools.wraps(func)
        def call(*columns):
            return F.pandas_udf(one if len(columns) == 1 else run, returns)(*columns)

        call.digest_parts = lambda: ("batch", str(returns), func, load)
        call.__signature__ = inspect.Signature(list(inspect.signature(func).parameters.values())[load is not None :])
        return call

    return decorate


class Reduction:
    """A reduction of a group's values. Over a GroupBy it is the plan's own aggregate: the map of the group is never built."""

    def __init__(self, name, aggregate, of_array):
        self.name, self.aggregate, self.of_array = name, aggregate, of_array

    def __call__(self, value):
        return self.of_array(F.map_values(value))

    def digest_parts(self):
        return ("reduction", self.name)


def _sum(array):
    return F.aggregate(F.filter(array, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)


count = Reduction("count", lambda c: F.count(F.lit(1)), lambda a: F.size(a).cast("long"))
total = Reduction("total", F.sum, _sum)
mean = Reduction("mean", F.avg, lambda a: _sum(a) / F.nullif(F.size(F.filter(a, lambda x: x.isNotNull())), F.lit(0)))
smallest = Reduction("smallest", F.min, F.array_min)
largest = Reduction("largest", F.max, F.array_max)
REDUCTIONS = (count, total, mean, smallest, largest)


def hash_id(columns):
    """The key of several strings: the SHA-256 of the concatenated SHA-256 digests of their UTF-8 bytes; of one, itself."""
    if len(columns) == 1:
        return columns[0]
    return F.sha2(F.concat(*(F.unhex(F.sha2(c, 256)) for c in columns)), 256)


def hash_array(column):
    """hash_id of the elements of an array of strings."""
    return F.sha2(F.aggregate(column, F.lit(b""), lambda a, x: F.concat(a, F.unhex(F.sha2(x, 256)))), 256)


def parts(ids, contexts):
    """For __split__: the parts with these ids (an array) and contexts (an array)."""
    return F.arrays_zip(ids.alias("id"), contexts.alias("context"))


def is_stable(value):
    """Says that a function's code will not change: its digest is its name."""
    value.digest_parts = lambda: ("stable", value.__module__, value.__qualname__)
    return value


def is_unstable(value):
    """Says that an installed library's function or class may change: its digest follows all that it refers to, as that of
    your own functions does anyway."""
    mark_unstable(f"{value.__module__}.{value.__qualname__}")
    return value


def unstable_module(module):
    """is_unstable for everything of a module (or of the module of that name)."""
    mark_unstable(module if isinstance(module, str) else module.__name__)
    return module
