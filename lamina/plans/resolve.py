"""Connecting what a class declares to the fields that came before."""

from dataclasses import replace

from pyspark.sql import functions as F

from .declare import Input, InverseInput, InverseOutput, Output, Parameter
from .names import DependencyError, FieldError, Names
from .nodes import Argument, Call, Constant, Lowering


class Absent(Exception):
    """An optional value's input is not there."""

    def __init__(self, name, soft):
        self.name, self.soft = name, soft


class Forward:
    """Nodes of a declaration's edges over the nodes of the previous layer."""

    def __init__(self, declared, values, before, key=None, extra=None):
        self.declared, self.values, self.before, self.key = declared, values, before, key
        self.extra = extra or {}
        self.edges = {e.name: e for e in declared.edges if e.kind != "back"}
        self.memo = {}

    def argument(self, place, edge):
        name = place.name
        if name in self.extra:
            return self.extra[name]
        if isinstance(place, Parameter):
            if name in self.edges:
                return self.own(name)
            if name in self.values:
                return Constant(self.values[name])
            raise FieldError(f"{self.declared.name} has no {name}, which {edge.name} needs")
        if isinstance(place, Output):
            if name in self.edges:
                return self.own(name)
            if name in self.declared.inherit or name == "id":
                return self.input(name, edge)
            raise DependencyError(f"{self.declared.name} has no output {name}, which {edge.name} needs")
        if isinstance(place, (Input,)):
            return self.input(name, edge)
        if isinstance(place, (InverseInput, InverseOutput)):
            raise FieldError(f"{edge.name} of {self.declared.name} can't depend on the way back")
        raise FieldError(f"{place!r} is not a place")

    def input(self, name, edge):
        if self.key is not None:
            return self.key(name, edge)
        if self.before.has(name):
            return self.before.node(name)
        raise Absent(name, name in self.before.absent or name in self.before.optional)

    def own(self, name):
        if name not in self.memo:
            e = self.edges[name]
            try:
                nodes = [self.argument(p, e) for p in e.places]
            except Absent as a:
                self.memo[name] = Absent(a.name, a.soft or "optional" in e.marks)
            else:
                self.memo[name] = e.call(nodes)
        if isinstance(self.memo[name], Absent):
            raise self.memo[name]
        return self.memo[name]

    def outputs(self):
        """(name -> node, optional names, names of optional ones that are not there)."""
        out, optional, absent = {}, set(), set()
        for e in self.edges.values():
            if e.kind != "output":
                continue
            try:
                out[e.name] = self.own(e.name)
            except Absent as a:
                if not (a.soft or "optional" in e.marks):
                    raise DependencyError(f"the field {a.name!r} that {e.name} of {self.declared.name} needs is not in {self.before.path or 'the chain'}") from None
                absent.add(e.name)
            inputs = [p.name for p in e.places if isinstance(p, Input)]
            if "optional" in e.marks or inputs and self.before is not None and all(n in self.before.optional for n in inputs):
                optional.add(e.name)
        return out, optional, absent

    def metas(self):
        """Properties: name -> function without arguments."""
        return {e.name: (lambda e=e: e.function(*[self._plain(p) for p in e.places])) for e in self.edges.values() if e.kind == "meta"}

    def _plain(self, place):
        if place.name in self.values:
            return self.values[place.name]
        if isinstance(place, Parameter) and place.name in self.edges:
            e = self.edges[place.name]
            return e.function(*[self._plain(p) for p in e.places])
        if place.name in self.edges and self.edges[place.name].kind == "meta":
            return self.metas()[place.name]()
        if self.before is not None and place.name in self.before.properties:
            return self.before.property(place.name)
        raise FieldError(f"a property can't depend on the field {place.name}")

    def undo(self):
        """The function that takes fields on the way back through this layer."""
        backs = [e for e in self.declared.edges if e.kind == "back"]

        def ahead(place):
            if isinstance(place, Parameter):
                return self.argument(place, place)
            if isinstance(place, Output):
                return self.own(place.name)
            return self.input(place.name, place)

        def step(current):
            def argument(place):
                if isinstance(place, InverseInput):
                    if place.name in current:
                        return current[place.name]
                    raise Absent(place.name, True)
                return back(place.name) if isinstance(place, InverseOutput) else ahead(place)

            memo = {}

            def back(name):
                if name not in memo:
                    e = next((e for e in backs if e.name == name), None)
                    if e is None:
                        raise Absent(name, True)
                    memo[name] = e.call([argument(p) for p in e.places])
                return memo[name]

            out = {n: node for n, node in current.items() if n in self.declared.inherit}
            for e in backs:
                try:
                    out[e.name] = back(e.name)
                except Absent:
                    pass
            return out

        step.nodes = []  # of the way ahead, that the way back needs
        for p in (p for e in backs for p in e.places if not isinstance(p, (InverseInput, InverseOutput))):
            try:
                step.nodes.append(ahead(p))
            except Absent:
                pass
        return step


def transformed(declared, values, data):
    """The Dataset after a transform."""
    forward = Forward(declared, values, data)
    own, optional, absent = forward.outputs()
    metas = forward.metas()
    passed = {n: node for n, node in data.outputs.items() if n not in own and n not in metas and (n in declared.inherit or n in data.persistent)}
    named = set() if declared.inherit.everything else {n for n in declared.inherit.names if n not in own}
    for n in sorted(named - set(passed)):
        if data.base is None and n in data.virtual:
            passed[n] = Argument(n)
    properties = {n: f for n, f in data.properties.items() if n in declared.inherit or n in data.persistent or n in data.properties}
    keep = {n for n in data.optional if n in passed}
    return replace(
        data,
        outputs=passed | own,
        virtual=(data.virtual & declared.inherit) - Names(set(own) | set(metas)),
        optional=frozenset(keep | optional),
        absent=frozenset({n for n in data.absent if n in declared.inherit} | absent),
        properties=properties | metas,
        back=None if data.back is None else (*data.back, forward.undo()),
        path=f"{data.path} >> {declared.name}" if data.path else declared.name,
    )


def truthy(frame, column):
    """A condition for where(), true where Python takes the value for true; where() drops nulls by itself, and a bare
    comparison reaches the scan."""
    kind = frame.select(column.alias("c")).schema["c"].dataType.typeName()
    if kind == "boolean":
        return column
    if kind in ("string", "binary"):
        return F.length(column) > 0
    if kind in ("array", "map"):
        return F.size(column) > 0
    return F.lit(False) if kind == "void" else column != 0


def function_node(function, data, layer, forbidden=()):
    """The node of a function whose parameters are names of fields."""
    from .declare import edge

    e = edge("predicate", function)
    for p in e.places:
        if p.name in forbidden:
            raise DependencyError(f"{layer} can't depend on {p.name}")
    return e.call([data.node(p.name, layer) for p in e.places])


__all__ = ["Call", "Lowering", "Forward", "transformed", "truthy", "function_node"]
