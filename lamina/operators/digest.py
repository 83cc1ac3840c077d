"""Digests as fields."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..plans.dataset import Layer
from ..plans.names import DependencyError, listed
from ..plans.nodes import Leaf, Lowering


ALGORITHMS = {"md5": F.md5, "sha1": F.sha1, **{f"sha{n}": (lambda c, n=n: F.sha2(c, n)) for n in (224, 256, 384, 512)}}


class HashDigest(Layer):
    """Replaces fields by struct<digest>: two digests are equal iff the values were made alike from the same entry. With
    return_value the struct begins with the value; with an algorithm (one of ALGORITHMS) it ends with the digest's hash by it."""

    def __init__(self, names, algorithm=None, return_value=False):
        algorithm = getattr(algorithm, "__name__", algorithm)
        if algorithm is not None and algorithm.removeprefix("openssl_") not in ALGORITHMS:
            raise ValueError(f"{algorithm!r} is none of {', '.join(ALGORITHMS)}")
        self.names, self.return_value = listed(names, "names"), return_value
        self.algorithm = algorithm and ALGORITHMS[algorithm.removeprefix("openssl_")]

    def _struct(self, value, digest):
        parts = [value.alias("value")] * bool(self.return_value) + [digest.alias("digest")]
        return F.struct(*parts, *([self.algorithm(digest).alias("hash")] if self.algorithm else []))

    def connect(self, data):
        if data.base is None:
            raise DependencyError("HashDigest needs a source")
        nodes = {n: data.node(n, "HashDigest") for n in self.names}

        def frame(base):
            low = Lowering(base)
            cols = {f"#hashed:{n}": self._struct(low.column(x), low.digest(x)) for n, x in nodes.items()}
            return low.frame.withColumns(cols)

        base = frame(data.base)

        kept = {n: x for n, x in data.outputs.items() if n in data.persistent}
        return replace(data, outputs=kept | {n: Leaf(f"#hashed:{n}") for n in self.names}, base=base, open=lambda key: frame(data.open(key)), back=None)

    def __repr__(self):
        return f"HashDigest({', '.join(self.names)})"
