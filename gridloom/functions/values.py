"""Arithmetic on matrix values: doubles, or structs (re, im) for complex matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Value types of a matrix; all reals are stored as double, complex64 as struct<re double, im double>.
REAL = ("float64", "float32", "float16", "bfloat16")
COMPLEX = "complex64"


def promoted(*kinds: str) -> str:
    """The type of a Kronecker product or a block matrix: complex over float32, equal types stay, else float32."""
    if COMPLEX in kinds:
        return COMPLEX
    return kinds[0] if len(set(kinds)) == 1 else "float32"


def sql_type(kind: str) -> str:
    return "struct<re:double,im:double>" if kind == COMPLEX else "double"


def lit(kind: str, x: complex) -> Column:
    return F.struct(F.lit(float(complex(x).real)).alias("re"), F.lit(float(complex(x).imag)).alias("im")) if kind == COMPLEX else F.lit(float(x))


def cast(v: Column, kind: str, to: str) -> Column:
    if kind == to or kind != COMPLEX and to != COMPLEX:
        return v
    if to == COMPLEX:
        return F.struct(v.alias("re"), F.lit(0.0).alias("im"))
    raise TypeError("complex values can't become real")


def mul(kind: str, a: Column, b: Column) -> Column:
    if kind != COMPLEX:
        return a * b
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def conj(kind: str, v: Column) -> Column:
    return F.struct(v["re"].alias("re"), (-v["im"]).alias("im")) if kind == COMPLEX else v


def total(kind: str, v: Column) -> Column:
    """The sum of a group, 0 of none."""
    if kind != COMPLEX:
        return F.coalesce(F.sum(v), F.lit(0.0))
    return F.struct(F.coalesce(F.sum(v["re"]), F.lit(0.0)).alias("re"), F.coalesce(F.sum(v["im"]), F.lit(0.0)).alias("im"))


def nonzero(kind: str, v: Column) -> Column:
    return (v["re"] != 0) | (v["im"] != 0) if kind == COMPLEX else v != 0


def square(kind: str, v: Column) -> Column:
    return v["re"] * v["re"] + v["im"] * v["im"] if kind == COMPLEX else v * v
