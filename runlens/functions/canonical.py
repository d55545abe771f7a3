"""Canonical JSON (RFC 8785), so that equal values have equal texts and digests whatever the order of keys or the form of numbers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_SPECIAL = re.compile(r'["\\\x00-\x1f]')


def number(x: float) -> str:
    """The shortest digits that give the double back; plain from 1e-6 to below 1e21, else with an exponent."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("no JSON number")
    if x == 0:
        return "0"
    digits, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = digits.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole.lstrip("0")) + int(exponent or 0) if whole.strip("0") else int(exponent or 0) - (len(part) - len(part.lstrip("0")))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        said = digits + "0" * (point - n)
    elif 0 < point <= 21:
        said = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        said = f"0.{'0' * -point}{digits}"
    else:
        said = f"{digits[0]}{'.' if n > 1 else ''}{digits[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" + said if x < 0 else said


def string(s: str) -> str:
    s.encode()  # half of a surrogate pair has no canonical form
    return '"' + _SPECIAL.sub(lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", s) + '"'


def spelled(value: object) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return string(value)
    if isinstance(value, (int, float)):
        return number(float(value))
    if isinstance(value, list):
        return f"[{','.join(map(spelled, value))}]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{string(k)}:{spelled(value[k])}" for k in keys) + "}"


def _refuse(name: str) -> None:
    raise ValueError(name)


def canonical(text: str | None) -> str | None:
    """None for no text, no JSON, and values without a canonical form (NaN, numbers too large, half surrogates)."""
    try:
        return None if text is None else spelled(json.loads(text, parse_constant=_refuse))
    except (ValueError, OverflowError, RecursionError):
        return None


def canonical_json(text: Column) -> Column:
    """The canonical text of a JSON text: keys by UTF-16 code units, the last of equal keys; null where there is none."""
    return F.pandas_udf(lambda s: pd.Series([canonical(t) for t in s], dtype="object"), "string")(text)


def canonical_hash(text: Column) -> Column:
    """`sha256:` and the digest of the canonical text."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text).cast("binary"), 256))


def argument_key(text: Column) -> Column:
    """Equal for equal arguments of calls; `undefined` for none captured. Arguments without a canonical form are an error."""
    found = F.coalesce(canonical_json(text), F.raise_error(F.concat(F.lit("no canonical form: "), F.substring(text, 1, 80))).cast("string"))
    return F.when(text.isNull(), "undefined").otherwise(found)


def code_units(text: Column) -> Column:
    """A binary that sorts as the text does by UTF-16 code units; differs from Spark's own order beyond U+FFFF."""
    return F.encode(text, "UTF-16BE")
