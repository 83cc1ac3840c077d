"""Predicates over entries: Filter and CheckIds."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..plans.dataset import Layer, rows_digest, session
from ..plans.names import DependencyError, HashError
from ..plans.nodes import Lowering, static_digest
from ..plans.resolve import function_node, truthy

#: Most ids that are written into the plan; more are joined.
LISTED = 1000


class Filter(Layer):
    """Keeps the entries for which the predicate (its parameters are fields) is true as Python has it; null is false.

    Only ids are filtered: an entry that is gone can still be read by its key, unless CheckIds follows.
    """

    def __init__(self, predicate, verbose=False, keys="ids"):
        self.predicate, self.keys = predicate, keys

    def connect(self, data):
        if data.base is None:
            raise DependencyError("Filter needs a source")
        node = function_node(self.predicate, data, "Filter", (self.keys,))
        if node.is_impure():
            raise HashError("a filter can't depend on an impure field")
        low = Lowering(data.base)
        base = low.frame.where(truthy(low.frame, low.column(node)))
        return replace(data, base=base, rows=rows_digest(data, "filter", static_digest(node)), back=None if data.back is None else data.back, path=f"{data.path} >> Filter")

    @classmethod
    def keep(cls, ids, verbose=False):
        """The entries with these ids."""
        return _Ids(ids, True)

    @classmethod
    def drop(cls, ids, verbose=False):
        """The entries without these ids."""
        return _Ids(ids, False)

    def __repr__(self):
        return "Filter()"


class _Ids(Layer):
    def __init__(self, ids, keep):
        if isinstance(ids, str):
            raise AssertionError("ids is a collection of strings, not one string")
        self.ids, self.kept = frozenset(ids), keep
        if not all(isinstance(i, str) for i in self.ids):
            raise AssertionError("ids must be strings")

    def connect(self, data):
        if data.base is None:
            raise DependencyError("Filter needs a source")
        ids = sorted(self.ids)
        if len(ids) <= LISTED:
            found = F.col("id").isin(ids)
            base = data.base.where(found if self.kept else ~found)
        else:
            listed = session().createDataFrame([(i,) for i in ids], "id string")
            base = data.base.join(listed, "id", "left_semi" if self.kept else "left_anti")
        return replace(data, base=base, rows=rows_digest(data, "ids", self.kept, tuple(ids)), path=f"{data.path} >> Filter")

    def __repr__(self):
        return f"Filter.{'keep' if self.kept else 'drop'}({len(self.ids)} ids)"


class CheckIds(Layer):
    """Reading a key that is not among the ids raises KeyError."""

    def connect(self, data):
        if data.base is None:
            raise DependencyError("CheckIds needs a source")
        base = data.base
        return replace(data, open=lambda key: base.where(F.col("id") == key), missing=KeyError)
