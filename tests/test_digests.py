"""Digests follow the value of every argument, closure and global; equal values have equal ones."""

import datetime as dt
import functools
import subprocess
import sys
import threading
from dataclasses import dataclass
from decimal import Decimal
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina import CacheColumns, CacheToDisk, CacheToRam, HashError, Source, Transform, meta
from lamina.functions import is_unstable, unstable_module
from lamina.plans import digests
from lamina.plans.digests import code_digest


@dataclass
class Setting:
    level: int
    of: dict


LIMITS = [1, 2]


def limited(x):
    return x > LIMITS[0]


def nested():
    return lambda x: x + LIMITS[1]


def test_values_of_any_kind():
    pairs = [
        (dt.date(2020, 1, 1), dt.date(2021, 1, 1)), (Decimal(1), Decimal(2)), (functools.partial(max, 1), functools.partial(max, 2)), (Setting(1, {"a": 2}), Setting(1, {"a": 3})),
        (np.arange(3), np.arange(1, 4)), ((dt.timedelta(1),) * 3, (dt.timedelta(1), dt.timedelta(2), dt.timedelta(2))), ({1, 2}, {1, 3}), (True, 1), ("1", 1), (np.float32(1), 1.0),
        (lambda x=dt.date(2020, 1, 1): x, lambda x=dt.date(2020, 1, 2): x), ({"a": 1, "b": 2}, {"a": 2, "b": 1}), (Setting(1, {}).__repr__, Setting(2, {}).__repr__), (len, max),
    ]
    for a, b in pairs:
        assert code_digest(a) != code_digest(b), (a, b)
    assert code_digest(Setting(1, {"a": 2, "b": 1})) == code_digest(Setting(1, {"b": 1, "a": 2}))
    f, g = (lambda x: x + 1), (lambda x: x + 2)
    assert code_digest((f, g, f)) != code_digest((f, g, g))
    loop = []
    loop.append(loop)
    assert code_digest(loop) == code_digest(loop)
    with pytest.raises(HashError):
        code_digest(threading.Lock())


def test_globals_and_closures(monkeypatch):
    plain, inner = code_digest(limited), code_digest(nested)
    monkeypatch.setitem(globals(), "LIMITS", [1, 3])
    assert code_digest(nested) != inner and code_digest(limited) != plain
    monkeypatch.setitem(globals(), "LIMITS", [1, 2])
    assert code_digest(nested) == inner

    def holding(day):
        return lambda x: x > day

    assert code_digest(holding(dt.date(2020, 1, 1))) != code_digest(holding(dt.date(2020, 1, 2))) == code_digest(holding(dt.date(2020, 1, 2)))


def test_hints(monkeypatch):
    monkeypatch.setattr(digests, "_UNSTABLE", set())
    import textwrap

    before = code_digest(textwrap.dedent)
    is_unstable(textwrap.dedent)
    assert code_digest(textwrap.dedent) != before
    whole = code_digest(textwrap.indent)
    unstable_module(textwrap)
    assert code_digest(textwrap.indent) != whole


def test_the_same_in_another_session():
    code = "import datetime as d; from decimal import Decimal; from lamina.plans.digests import code_digest; print(code_digest([d.date(2020, 1, 1), {'a', 'b', 'c'}, {'x': Decimal(1)}, lambda q: q in ('u', 'v') or q in {'m', 'n', 'o'}]))"
    root = str(Path(__file__).parent.parent)
    assert len({subprocess.run([sys.executable, "-c", code], cwd=root, env={"PYTHONHASHSEED": s, "PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout for s in ("1", "2")}) == 1


class Days(Source):
    @meta
    def ids():
        return ["a", "b"]

    def text(i):
        return i


class Dated(Transform):
    _day: dt.date

    def day(text, _day):
        return F.concat(text, F.lit(str(_day)))


@pytest.mark.parametrize("kind", ["ram", "disk", "columns"])
def test_no_stale_entry(spark, tmp_path, kind):
    cache = {"ram": CacheToRam(), "disk": CacheToDisk.simple(root=f"{tmp_path}/d"), "columns": CacheColumns.simple(root=f"{tmp_path}/c")}[kind]
    for day in (dt.date(2020, 1, 1), dt.date(2021, 1, 1), dt.date(2020, 1, 1)):
        assert sorted(r.day for r in (Days() >> Dated(day=day) >> cache).to_df().collect()) == [f"a{day}", f"b{day}"]
