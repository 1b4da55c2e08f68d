"""JSON operators on JSON text: path access by built-ins, containment and keys as Arrow-batched functions."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get(x: Column, *path: str | int) -> Column:
    """->> and #>>: the text at a path."""
    return F.get_json_object(x, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def _holds(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _holds(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(_holds(x, y) for x in a) for y in b)
    if isinstance(a, list) and not isinstance(b, dict):
        return any(type(x) is type(b) and x == b for x in a)
    return type(a) is type(b) and a == b


@F.pandas_udf(T.BooleanType())
def contains(a: pd.Series, b: pd.Series) -> pd.Series:
    """a @> b."""
    read = functools.lru_cache(64)(json.loads)  # a constant side is read once a batch
    return pd.Series([None if x is None or y is None else _holds(json.loads(x), read(y)) for x, y in zip(a, b)], dtype=object)


def _keys(a) -> set:
    a = json.loads(a)
    return set(a) if isinstance(a, dict) else {x for x in a if isinstance(x, str)} if isinstance(a, list) else {a} if isinstance(a, str) else set()


@F.pandas_udf(T.BooleanType())
def has_any(a: pd.Series, keys: pd.Series) -> pd.Series:
    """a ?| keys."""
    return pd.Series([None if x is None or y is None else bool(_keys(x) & set(y)) for x, y in zip(a, keys)], dtype=object)


@F.pandas_udf(T.BooleanType())
def has_all(a: pd.Series, keys: pd.Series) -> pd.Series:
    """a ?& keys."""
    return pd.Series([None if x is None or y is None else set(y) <= _keys(x) for x, y in zip(a, keys)], dtype=object)


@F.pandas_udf(T.StringType())
def remove(a: pd.Series, path: pd.Series) -> pd.Series:
    """a #- path."""

    def one(x, steps):
        root = at = json.loads(x)
        try:
            for step in steps[:-1]:
                at = at[int(step) if isinstance(at, list) else step]
            del at[int(steps[-1]) if isinstance(at, list) else steps[-1]]
        except (KeyError, IndexError, TypeError, ValueError):
            pass
        return json.dumps(root)

    return pd.Series([None if x is None or y is None else one(x, list(y)) for x, y in zip(a, path)], dtype=object)


def typeof(x: Column) -> Column:
    start = F.substring(F.trim(x), 1, 1)
    return F.when(start == "{", "object").when(start == "[", "array").when(start == '"', "string").when(start.isin("t", "f"), "boolean").when(start == "n", "null").when(x.isNotNull(), "number")


@F.pandas_udf(T.StringType())
def pretty(a: pd.Series) -> pd.Series:
    """Indented by four spaces, keys in order."""
    return pd.Series([None if x is None else json.dumps(json.loads(x), indent=4, sort_keys=True, ensure_ascii=False) for x in a], dtype=object)
