"""Scalar functions that Spark lacks or that differ: errors instead of nulls, patterns, quantified comparisons, hashes."""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unless(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def ln(x: Column) -> Column:
    return _unless(x == 0, "cannot take logarithm of zero", _unless(x < 0, "cannot take logarithm of a negative number", F.ln(x)))


def log(x: Column, base: Column | None = None) -> Column:
    """Base 10, or the given base."""
    return ln(x) / (F.ln(base) if base is not None else F.ln(F.lit(10.0)))


def sqrt(x: Column) -> Column:
    return _unless(x < 0, "cannot take square root of a negative number", F.sqrt(x))


def pow_int(x: Column, y: Column) -> Column:
    """Integer power by repeated multiplication; a result beyond 64 bits or a negative exponent is an error."""
    big, bound = "decimal(38,0)", F.lit(str(2**63)).cast("decimal(38,0)")
    wrong = F.raise_error(F.lit("integer out of range")).cast(big)
    times = lambda a, _: F.when(F.abs(a) >= bound, wrong).otherwise((a * x.cast("decimal(19,0)")).cast(big))
    # Beyond 64 factors only -1, 0 and 1 stay in range; their power depends on whether the exponent is even.
    factors = F.when(y <= 64, y).otherwise(F.when(F.abs(x) <= 1, 2 + y % 2).otherwise(65))
    value = F.aggregate(F.when(y > 0, F.sequence(F.lit(1), factors.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1).cast(big), times)
    value = F.when(y < 0, wrong).when((value >= bound) | (value < -bound), wrong).otherwise(value)
    return value.cast("bigint")


def div(x: Column, y: Column) -> Column:
    """Division that truncates toward zero."""
    return F.call_function("div", x, y)


def trunc(x: Column, digits: int = 0) -> Column:
    scale = F.lit(10.0**digits)
    return F.when(x >= 0, F.floor(x * scale)).otherwise(F.ceil(x * scale)) / scale


def similar_to(x: Column, pattern: str, escape: str = "\\") -> Column:
    """SQL's SIMILAR TO as a regular expression over the whole string."""
    return x.rlike(similar_regex(pattern, escape))


def similar_regex(pattern: str, escape: str = "\\") -> str:
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if escape and c == escape and k + 1 < len(pattern):
            k += 1
            out.append("\\" + pattern[k] if not pattern[k].isalnum() else pattern[k])
        elif inside:
            inside = c != "]"
            out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        k += 1
    return "(?s)^(?:" + "".join(out) + ")$"


_COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def any_of(x: Column, op: str, array: Column) -> Column:
    """x op ANY (array), with SQL's three-valued logic."""
    return F.exists(array, lambda y: _COMPARE[op](x, y))


def all_of(x: Column, op: str, array: Column) -> Column:
    """x op ALL (array)."""
    return F.forall(array, lambda y: _COMPARE[op](x, y))


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    return x.between(F.least(a, b), F.greatest(a, b))


def array_length(array: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(array) > 0, F.size(array))


def array_contains_all(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.size(F.array_except(b, a)) == 0


def _each_byte(s: pd.Series, start: int, step) -> pd.Series:
    """A checksum of many texts at once: `step` takes the state of all texts that are long enough and their next byte."""
    known = s.notna().to_numpy()
    raw = [t.encode() for t in s[known]]
    sizes = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat, starts = np.frombuffer(b"".join(raw[k] for k in order), np.uint8), np.concatenate([[0], np.cumsum(sizes[order])[:-1]]).astype(np.int64)
    h, longest = np.full(len(raw), start, np.uint64), int(sizes.max(initial=0))
    left = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    for k in range(longest):
        n = left[k]
        h[:n] = step(h[:n], flat[starts[:n] + k].astype(np.uint64))
    back = np.empty(len(raw), np.uint64)
    back[order] = h
    out = pd.Series(pd.NA, index=s.index, dtype="Int64")
    out[known] = back.view(np.int64)
    return out


def _fnv(bits: int, prime: int, basis: int, xor_first: bool):
    mask, prime = np.uint64((1 << bits) - 1), np.uint64(prime)

    def step(h, byte):
        return ((h ^ byte) * prime) & mask if xor_first else ((h * prime) & mask) ^ byte

    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        return _each_byte(s, basis, step)

    return run


#: FNV constants: (prime, offset basis) of 32 and 64 bits.
FNV = {32: (0x01000193, 0x811C9DC5), 64: (0x100000001B3, 0xCBF29CE484222325)}
#: Castagnoli's polynomial, reflected.
CRC32C = 0x82F63B78

fnv32, fnv32a = (_fnv(32, *FNV[32], xor_first) for xor_first in (False, True))
fnv64, fnv64a = (_fnv(64, *FNV[64], xor_first) for xor_first in (False, True))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        table = (table >> np.uint64(1)) ^ np.where(table & np.uint64(1), np.uint64(CRC32C), np.uint64(0))
    return table


@F.pandas_udf(T.LongType())
def crc32c(s: pd.Series) -> pd.Series:
    table = _crc_table()
    return _each_byte(s, 0xFFFFFFFF, lambda h, byte: (h >> np.uint64(8)) ^ table[((h ^ byte) & np.uint64(255)).astype(np.int64)]) ^ 0xFFFFFFFF


def crc32ieee(x: Column) -> Column:
    return F.crc32(x.cast("binary"))


def quote_literal(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
