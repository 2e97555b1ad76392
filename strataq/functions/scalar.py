"""Scalar functions as Column builders; all stay in the JVM."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def tokens(c: Column) -> Column:
    """Runs of Unicode letters and digits, with A-Z alone lower-cased."""
    return F.filter(F.split(ascii_lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def text_relevance(*columns: Column) -> Column:
    """Distinct words plus the root of the byte length, summed over text attributes."""
    total = F.lit(0.0)
    for c in columns:
        words = F.size(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != "")))
        total = total + F.coalesce(words + F.sqrt(F.octet_length(c)), F.lit(0.0))
    return total


def composite_key(*parts: Column) -> Column:
    """Each part's length as four big-endian bytes, then its bytes; null if any part is."""
    pieces = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), p.cast("binary")) for p in parts]
    return F.concat(*pieces)


def heat(reads: Column, writes: Column, age: Column) -> Column:
    return F.floor((reads + writes * 4) * 1000 / F.greatest(age, F.lit(1))).cast("long")


def tier(score: Column, hot: int = 1000, warm: int = 100) -> Column:
    return F.when(score >= hot, "hot").when(score >= warm, "warm").otherwise("cold")


def arithmetic(left: Column, op: str, right: Column) -> Column:
    """One binary operation on doubles; x / 0 is 0."""
    l, r = left.cast("double"), right.cast("double")
    return {"*": l * r, "-": l - r, "+": l + r, "/": F.when(r == 0, F.lit(0.0)).otherwise(F.try_divide(l, r))}[op]


def computed(expression: str, columns: list[str]) -> Column:
    """A computed field: an attribute, a concatenation with quoted parts, or one arithmetic operation.

    Operators are tried in the order * / - +.  A name that is no column makes the
    value null; numbers are literals.
    """
    e = expression.strip()
    if e in columns:
        return F.col(e)
    if "'" in e or '"' in e:
        parts = []
        for p in re.findall(r"'[^']*'|\"[^\"]*\"|[^+]+", e):
            p = p.strip()
            if p[:1] in "'\"" and p[:1]:
                parts.append(F.lit(p[1:-1]))
            elif p:
                parts.append(F.col(p).cast("string") if p in columns else F.lit(p))
        return F.concat(*parts)
    for op in "*/-+":
        left, found, right = e.partition(op)
        if found:
            sides = [F.col(s) if (s := x.strip()) in columns else F.lit(s).try_cast("double") for x in (left, right)]
            return arithmetic(sides[0], op, sides[1])
    return F.lit(None)


def literal(text: str):
    """A literal's value: JSON, else whole number, double, boolean, text."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)
