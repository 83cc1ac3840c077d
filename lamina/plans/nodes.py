"""Fields as small expression graphs over the columns of a base DataFrame.

A node becomes a Column only when fields are asked for together: each node is then made once, so
Catalyst sees one projection, prunes what is unused and shares what is repeated. Impure nodes are
projected before their users, so that all of them see one value. Beside its value a node has a digest: a
Column that follows the provenance of the value (functions, their code and the row they come from).
"""

import inspect

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import code_digest
from .names import HashError


def quoted(name):
    return F.col("`" + name.replace("`", "``") + "`")


def projected(frame, columns):
    """frame with the columns of (name, Column) pairs; names are given last, so that none hides a column of frame."""
    pairs = list(columns)
    return frame.select(*(c.alias(f"#out:{i}") for i, (_, c) in enumerate(pairs))).toDF(*(n for n, _ in pairs))


class Node:
    impure = False

    def inputs(self):
        """Names of chain inputs that this node needs."""
        return set().union(*(n.inputs() for n in self.parts()))

    def parts(self):
        return ()

    def is_impure(self):
        return self.impure or any(n.is_impure() for n in self.parts())


class ByRow:
    """The digest of a table's column: of the table, the column's name and the row's id. It needs no column of its own."""

    def __init__(self, rows, name):
        self.rows, self.name = rows, name

    def column(self):
        return F.sha2(F.concat_ws("|", F.lit(self.rows), F.lit(self.name), F.col("id")), 256)


class Leaf(Node):
    """A column of the base; `digest` is the name of the column that has its digest, or a ByRow; `impure` says that its values
    can't be had again."""

    def __init__(self, column, digest=None, impure=False):
        self.column, self.digest, self.impure = column, digest, impure


class Argument(Node):
    """An input of a chain that has no source yet."""

    def __init__(self, name):
        self.name = name

    def inputs(self):
        return {self.name}


class Constant(Node):
    def __init__(self, value):
        self.value = value


class Call(Node):
    """A function of other nodes' columns. silent: positions of arguments that the digest leaves out."""

    def __init__(self, function, args, names=(), silent=(), impure=False, by_value=False, code=None):
        self.function, self.args, self.names, self.silent = function, tuple(args), tuple(names), frozenset(silent)
        self.impure, self.by_value, self.code = impure, by_value, code

    def parts(self):
        return self.args

    def call(self, values):
        k = len(values) - len(self.names)
        return self.function(*values[:k], **dict(zip(self.names, values[k:])))


class Item(Node):
    """One of several results of a function."""

    def __init__(self, node, index, size):
        self.node, self.index, self.size = node, index, size

    def parts(self):
        return (self.node,)


class Kept(Node):
    """A leaf that holds what `node` gives: it has that node's digest."""

    def __init__(self, leaf, node):
        self.leaf, self.node = leaf, node

    def parts(self):
        return (self.node,)


def as_column(value):
    if isinstance(value, Column):
        return value
    if isinstance(value, str) and "Column<" in value:
        raise TypeError("a field's function made a string of a Column; mark it with py() if it is plain Python")
    if isinstance(value, (list, tuple)):
        return F.array(*map(as_column, value))
    if isinstance(value, dict):
        return F.create_map(*(as_column(x) for kv in value.items() for x in kv))
    return F.lit(value)


class Lowering:
    """Columns of nodes over a base; `frame` is the base with what had to be projected first."""

    def __init__(self, frame):
        self.frame, self.done, self.digests, self.count = frame, {}, {}, 0

    def value(self, node):
        """What the node's function gave: a Column or, for several results, a tuple."""
        if node in self.done:
            return self.done[node]
        if isinstance(node, Leaf):
            out = quoted(node.column)
        elif isinstance(node, Kept):
            out = self.value(node.leaf)
        elif isinstance(node, Argument):
            out = quoted(node.name)
        elif isinstance(node, Constant):
            out = node.value
        elif isinstance(node, Item):
            whole = self.value(node.node)
            if isinstance(whole, (tuple, list)):
                if len(whole) != node.size:
                    raise ValueError(f"the function gave {len(whole)} results, not {node.size}")
                out = as_column(whole[node.index])
            else:
                out = whole.getItem(node.index) if _is_array(self.frame, whole) else whole.getField(_field(self.frame, whole, node.index))
        elif (name := self._aggregated(node)) is not None:
            out = quoted(name)
        else:
            out = node.call([self.value(n) for n in node.args])
            if not isinstance(out, (tuple, list)) or not _several(out):
                out = as_column(out)
                if node.impure:
                    self.count += 1
                    name = f"#impure:{self.count}:{id(self)}"
                    self.frame = self.frame.withColumn(name, out)
                    out = quoted(name)
        self.done[node] = out
        return out

    def _aggregated(self, node):
        """The column of the base that already holds this reduction of a group, or None."""
        if hasattr(node.function, "aggregate") and len(node.args) == 1 and isinstance(node.args[0], Leaf):
            name = f"#{node.function.name}:{node.args[0].column}"
            return name if name in self.frame.columns else None
        return None

    def column(self, node):
        return as_column(self.value(node))

    def digest(self, node):
        """A Column with the digest of the node's value."""
        if node in self.digests:
            return self.digests[node]
        if isinstance(node, Leaf):
            if node.impure:
                raise HashError("a value that depends on an impure function has no digest")
            out = node.digest.column() if isinstance(node.digest, ByRow) else quoted(node.digest) if node.digest else F.sha2(F.to_json(F.struct(quoted(node.column).alias("v"))), 256)
        elif isinstance(node, Kept):
            out = self.digest(node.node)
        elif isinstance(node, Argument):
            out = F.sha2(F.to_json(F.struct(quoted(node.name).alias("v"))), 256)
        elif isinstance(node, Constant):
            out = F.lit(code_digest(node.value))
        elif isinstance(node, Item):
            out = F.sha2(F.concat(F.lit(f"item {node.index}"), self.digest(node.node)), 256)
        elif node.impure:
            raise HashError("a value that depends on an impure function has no digest")
        elif node.by_value:
            out = F.sha2(F.to_json(F.struct(self.column(node).alias("v"))), 256)
        elif node.code == "identity":
            out = self.digest(node.args[0])
        else:
            own = node.code or code_digest((node.function, node.names))
            out = F.sha2(F.concat(F.lit(own), *(self.digest(n) for i, n in enumerate(node.args) if i not in node.silent)), 256)
        self.digests[node] = out
        return out


def columns_of(node, digest=False):
    """Names of the base's columns that the node's value, or its digest, is made of."""
    if isinstance(node, Leaf):
        if not digest:
            return {node.column}
        return {"id"} if isinstance(node.digest, ByRow) else {node.digest or node.column}
    if isinstance(node, Kept):
        return columns_of(node.node, True) if digest else columns_of(node.leaf)
    if isinstance(node, Call):
        if digest and not node.by_value:
            args = [node.args[0]] if node.code == "identity" else [n for i, n in enumerate(node.args) if i not in node.silent]
            return set().union(*(columns_of(n, True) for n in args))
        reduced = {f"#{node.function.name}:{n.column}" for n in node.args if isinstance(n, Leaf)} if hasattr(node.function, "aggregate") else set()
        return reduced.union(*(columns_of(n) for n in node.args))
    return set().union(*(columns_of(n, digest) for n in node.parts()))


def _several(value):
    return any(isinstance(x, Column) for x in value)


def _is_array(frame, column):
    return frame.select(column.alias("c")).schema["c"].dataType.typeName() == "array"


def _field(frame, column, index):
    return frame.select(column.alias("c")).schema["c"].dataType.names[index]


def static_digest(node):
    """A digest of the node's plan, without its rows: of two nodes with equal ones the values are made alike."""
    if isinstance(node, Leaf):
        if node.impure:
            raise HashError("impure")
        return code_digest(("leaf", node.column))
    if isinstance(node, Kept):
        return static_digest(node.node)
    if isinstance(node, Argument):
        return code_digest(("argument", node.name))
    if isinstance(node, Constant):
        return code_digest(("constant", node.value))
    if isinstance(node, Item):
        return code_digest(("item", node.index, static_digest(node.node)))
    if node.impure:
        raise HashError("impure")
    if node.code == "identity":
        return static_digest(node.args[0])
    return code_digest(("call", node.code or code_digest((node.function, node.names)), tuple(static_digest(n) for i, n in enumerate(node.args) if i not in node.silent)))


def parameters(function):
    """Parameters of a function that may be a field; only plain positional ones without defaults are allowed."""
    found = list(inspect.signature(function).parameters.values())
    for p in found:
        if p.kind not in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD):
            raise TypeError(f"the parameter {p.name} must be a plain positional one")
        if p.default is not p.empty:
            raise ValueError(f"the parameter {p.name} can't have a default value")
    return found
