"""Path, name and hash expressions."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


#: An exporter's suffix; limits of the Hamming distance and their names.
EXPORT_SUFFIX = r"\.rf\.[0-9a-fA-F]+$"
DISTANCES = ((4, "VERY_SIMILAR"), (8, "POSSIBLY_SIMILAR"))


def source_group(name: Column) -> Column:
    """Name without an exporter's hexadecimal suffix."""
    return F.regexp_replace(name, EXPORT_SUFFIX, "")


def stable_id(*parts: Column, length: int = 20) -> Column:
    """First hexadecimal digits of the SHA-256 of the parts joined by colons."""
    return F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(length))


def set_digest(items: Column) -> Column:
    """SHA-256 of a set of strings, whatever their order."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.array_sort(items), ","), F.lit("]")), 256)


def escaped(value: Column) -> Column:
    """Text as HTML says it."""
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(plain), F.lit(name))
    return value


def decimals(value: Column, digits: int = 4) -> Column:
    """A number with so many decimals, n/a where there is none."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double"))).otherwise("n/a")


def hamming(a: str, b: str) -> str:
    return f"bit_count({a} ^ {b})"


def similarity(distance: str) -> str:
    return "case " + " ".join(f"when {distance} <= {most} then '{name}'" for most, name in DISTANCES) + " end"


@F.pandas_udf(T.StringType())
def canonical_id(text: pd.Series) -> pd.Series:
    """16 hexadecimal digits of the SHA-256 of a JSON value written with sorted keys, default separators and ASCII escapes."""
    import hashlib

    return text.map(lambda t: None if t is None else hashlib.sha256(json.dumps(json.loads(t), sort_keys=True).encode()).hexdigest()[:16])


SIDE, LOW = 32, 8


def cosine_waves() -> list[list[float]]:
    """waves[u][x]: the orthonormal cosine of frequency u at place x."""
    return [[math.cos(math.pi * u * (2 * x + 1) / (2 * SIDE)) * math.sqrt((2 if u else 1) / SIDE) for x in range(SIDE)] for u in range(LOW)]


def cosine_hash(grey: Column) -> Column:
    """``perceptual_hash`` as native array arithmetic: rows, then columns times the waves, then a bit for each coefficient above the median of all but the first."""
    waves = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in row) + ")" for row in cosine_waves()) + ")")
    line = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    dot = lambda of, u: F.aggregate(line(SIDE), F.lit(0.0), lambda a, x: a + of(x) * F.get(F.get(waves, u), x))
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  (computed once, however often f names it)
    rows = once(grey, lambda g: F.flatten(F.transform(line(SIDE), lambda y: F.transform(line(LOW), lambda v: dot(lambda x: F.get(g, y * SIDE + x), v)))))
    both = once(rows, lambda r: F.flatten(F.transform(line(LOW), lambda u: F.transform(line(LOW), lambda v: dot(lambda y: F.get(r, y * LOW + v), u)))))
    middle = LOW * LOW // 2 - 1
    bits = once(both, lambda c: once(F.get(F.sort_array(F.slice(c, 2, LOW * LOW - 1)), F.lit(middle)), lambda m: F.transform(c, lambda x, k: F.when((k > 0) & (x > m), "1").otherwise("0"))))
    return F.when(F.size(grey) == SIDE * SIDE, F.lower(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), LOW * LOW // 4, "0")))


@F.pandas_udf(T.StringType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    """Hexadecimal hash of images of SIDE * SIDE grey values: a bit for each of LOW * LOW low cosine coefficients.

    Bit (u, v) says whether the coefficient of vertical frequency u and horizontal frequency v is above the median of all but (0, 0), whose bit is 0.
    A whole batch is two matrix products; images of another size have no hash.
    """
    import numpy as np

    fits = pixels.map(lambda x: x is not None and len(x) == SIDE * SIDE).to_numpy(dtype=bool)
    out = pd.Series([None] * len(pixels), dtype=object)
    if fits.any():
        grey = np.stack(pixels[fits].to_list()).astype(float).reshape(-1, SIDE, SIDE)
        phase = np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) * (np.pi / (2 * SIDE))
        waves = np.cos(phase) * np.where(np.arange(LOW) == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))[:, None]
        coefficients = np.einsum("uy,nyx,vx->nuv", waves, grey, waves, optimize=True).reshape(len(grey), -1)
        above = coefficients > np.median(coefficients[:, 1:], axis=1, keepdims=True)
        above[:, 0] = False
        out[np.flatnonzero(fits)] = [b.tobytes().hex() for b in np.packbits(above, axis=1)]
    return out
