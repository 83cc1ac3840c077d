"""lamina: keyed, composable datasets that compile to lazy Spark plans."""

import importlib

__version__ = "0.1.0"

_PLACES = {
    "functions": "batch py",
    "operators": "Apply CacheColumns CacheLayer CacheToDisk CacheToRam CheckIds Filter GroupBy HashDigest Join JoinMode Merge Split Transform TransformBase",
    "operators.serializers": "ChainSerializer JsonSerializer Serializer",
    "plans.dataset": "CallableLayer Chain Dataset Layer LazyChain chained",
    "plans.declare": "AsOutput Function Input InverseInput InverseOutput Mixin Output Parameter Silent hash_by_value impure inverse meta optional positional",
    "plans.names": "DependencyError FieldError GraphError HashError Names",
    "sources": "External ExternalBase Source SourceBase",
}
_PLACE = {name: place for place, names in _PLACES.items() for name in names.split()}
__all__ = sorted(_PLACE)


def __getattr__(name):
    """Public names, imported when they are first used: workers that need one module load no other."""
    if name not in _PLACE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_PLACE[name]}"), name)
