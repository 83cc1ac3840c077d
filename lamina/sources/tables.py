"""Digests of tables by what they are read from."""

import re

from pyspark.sql import SparkSession

from ..plans.digests import code_digest

_STATUS = re.compile(r"path=([^;]*);.*?length=(\d+);.*?modification_time=(\d+)", re.S)


def _file_system(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(path):
    fs, where = _file_system(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), path)  # threads have no active one
    return fs.exists(where)


def _files(frame):
    """(path, bytes, time of change) of every file that a frame's plan reads. Spark's driver has listed them already; one call
    brings the listing over, in some 400 bytes a file."""
    found = []
    leaves = frame._jdf.queryExecution().analyzed().collectLeaves().iterator()
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found += _STATUS.findall(leaf.relation().location().allFiles().toString())
    return sorted(found)


def table_digest(frame):
    """Follows a frame's plan and the files that it reads, with their sizes and times of change."""
    files = _files(frame)
    return code_digest((frame.schema.json(), tuple(files))) if files and _plain(frame) else code_digest((frame.schema.json(), tuple(files), frame.semanticHash()))


def _plain(frame):
    """Whether a frame is just a table, so that its digest can hold in later sessions."""
    return frame._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
