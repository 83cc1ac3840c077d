"""How values are written by caches on disk: as Parquet has them by default, or as a serializer makes them."""

from pyspark.sql import functions as F
from pyspark.sql import types as T


class Serializer:
    """encode and decode are functions of Columns; fits says which types a serializer takes."""

    def fits(self, kind):
        return True

    def encode(self, column, kind):
        return column

    def decode(self, column, kind):
        return column


class JsonSerializer(Serializer):
    """JSON strings: readable for any other program. Binary values don't fit."""

    def fits(self, kind):
        return "binary" not in kind.simpleString()

    def encode(self, column, kind):
        return F.to_json(F.struct(column.alias("value")), {"ignoreNullFields": "false"})

    def decode(self, column, kind):
        return F.from_json(column, T.StructType([T.StructField("value", kind)]))["value"]


class ChainSerializer(Serializer):
    """The first of several that fits a field's type."""

    def __init__(self, *serializers):
        self.serializers = serializers

    def _of(self, kind):
        for s in self.serializers:
            if s.fits(kind):
                return s
        raise TypeError(f"no serializer fits {kind.simpleString()}")

    def fits(self, kind):
        return any(s.fits(kind) for s in self.serializers)

    def encode(self, column, kind):
        return self._of(kind).encode(column, kind)

    def decode(self, column, kind):
        return self._of(kind).decode(column, kind)
