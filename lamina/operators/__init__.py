"""Layers: each turns a dataset into another one."""

from .caches import Cache, CacheColumns, CacheLayer, CacheToDisk, CacheToRam, MemoryCache, ParquetCache
from .digest import HashDigest
from .filters import CheckIds, Filter
from .relational import GroupBy, Join, JoinMode, Merge, Split
from .transform import Apply, Transform, TransformBase

__all__ = ["Apply", "Cache", "CacheColumns", "CacheLayer", "CacheToDisk", "CacheToRam", "CheckIds", "Filter", "GroupBy", "HashDigest", "Join", "JoinMode", "MemoryCache", "Merge", "ParquetCache", "Split", "Transform", "TransformBase"]
