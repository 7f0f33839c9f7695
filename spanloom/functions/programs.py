"""Analysts' programs as SQL expressions from an allow-list, and a hashed text sketch as a vectorised function."""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a program may call.
ALLOWED = frozenset(
    "abs avg bool_and bool_or cast ceil coalesce cos count exp floor greatest hypot if isnan least ln log log10 log2 max mean median min mode nullif pow power round sign sin size sqrt stddev stddev_pop stddev_samp sum tan var_samp variance".split()
)
WORDS = frozenset("and or not case when then else end is null in between like true false as distinct int bigint double string".split())
LONGEST = 2000
TOKEN = re.compile(r"\s+|(?P<string>'(?:[^'\\])*')|(?P<name>[A-Za-z_][A-Za-z_0-9]*)(?P<call>\s*\()?|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[-+*/%(),.<>=!]")


def program(text: str, columns: list[str]) -> Column:
    """The expression, if it is built of allowed functions, the given columns, numbers and plain strings; else ValueError."""
    if not text or len(text) > LONGEST:
        raise ValueError("a program has 1 to 2000 characters")
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"not allowed at {at}: {text[at : at + 10]!r}")
        name = (m["name"] or "").lower()
        if name and m["call"] and name not in ALLOWED | WORDS:
            raise ValueError(f"function {name!r} is not allowed")
        if name and not m["call"] and name not in WORDS and m["name"] not in columns:
            raise ValueError(f"no column {m['name']!r}")
        at = m.end()
    if "--" in text or "/*" in text:
        raise ValueError("comments are not allowed")
    return F.expr(text)


SKETCH_WORD = re.compile("[a-z0-9']+")
#: Words that a sketch leaves out.
SKETCH_STOP = frozenset("the a an and or but if then of to in on at for with by is are was were be been being it its this that these those as from into about over under he she they we you i not no do does did so such than".split())


def sketch(text: str, dim: int = 384) -> np.ndarray:
    """A unit vector of signed hashed counts of words, pairs and every second four characters."""
    words = [w for w in SKETCH_WORD.findall((text or "").lower()) if len(w) > 1 and w not in SKETCH_STOP]
    flat = " ".join(words)
    parts = ((1.0, words), (1.3, [f"{a}_{b}" for a, b in pairwise(words)]), (0.45, [flat[i : i + 4] for i in range(0, len(flat) - 3, 2)]))
    out = np.zeros(dim)
    for k, (weight, features) in enumerate(parts):
        for f, n in Counter(features).items():
            h = crc32(f"{k}:{f}".encode())
            out[h % dim] += (1 if h >> 31 else -1) * weight * (1 + np.log(n))
    return out / max(float(np.linalg.norm(out)), 1e-12)


def sketch_column(text: Column, dim: int = 384) -> Column:
    """``sketch`` over Arrow batches, as array<float>."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sketch(t, dim).astype(np.float32))

    return run(text)
