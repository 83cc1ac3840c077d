"""Sets of field names and the errors of the library."""


class GraphError(Exception):
    """The declarations of a layer contradict each other."""


class DependencyError(GraphError):
    """A field that is needed is not there."""


class FieldError(Exception):
    """A field does not exist or is declared wrongly."""


class HashError(RuntimeError):
    """A value has no reproducible digest."""


class Names:
    """A finite set of names, or all names but those of one (everything=True)."""

    def __init__(self, names=(), everything=False):
        self.names, self.everything = frozenset(names), everything

    def __contains__(self, name):
        return (name in self.names) != self.everything

    def __and__(self, other):
        if self.everything and other.everything:
            return Names(self.names | other.names, True)
        if self.everything or other.everything:
            some, rest = (other, self) if self.everything else (self, other)
            return Names(some.names - rest.names)
        return Names(self.names & other.names)

    def __or__(self, other):
        return ~(~self & ~other)

    def __invert__(self):
        return Names(self.names, not self.everything)

    def __sub__(self, other):
        return self & ~other

    def __eq__(self, other):
        return isinstance(other, Names) and (self.names, self.everything) == (other.names, other.everything)

    def __hash__(self):
        return hash((self.names, self.everything))

    def __repr__(self):
        return f"{'all but ' if self.everything else ''}{{{', '.join(sorted(self.names))}}}"


def listed(names, what):
    """A tuple of names from one name or a collection of them."""
    if isinstance(names, str):
        return (names,)
    if isinstance(names, bool) or not hasattr(names, "__iter__"):
        raise TypeError(f"{what} must be a name or a collection of names, not {names!r}")
    names = tuple(names)
    if not all(isinstance(x, str) for x in names):
        raise TypeError(f"{what} must hold names only")
    return names


def inherited(inherit=(), exclude=()):
    """What a layer passes on: all names, those of `inherit`, or all but those of `exclude`."""
    if exclude or isinstance(exclude, str) and exclude:
        if inherit:
            raise ValueError("a layer can't both inherit and exclude")
        return Names(listed(exclude, "__exclude__"), True)
    listed(exclude, "__exclude__")
    if inherit is True:
        return Names((), True)
    if inherit is False:
        raise TypeError("__inherit__ is True, a name or a collection of names")
    return Names(listed(inherit, "__inherit__"))
