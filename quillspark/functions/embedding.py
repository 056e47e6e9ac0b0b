"""Vectors as little-endian 32-bit floats in binary columns, and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """array<float> to bytes; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Bytes to array<float>; trailing bytes that make no whole number are ignored."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


@F.pandas_udf(T.StringType())
def fix_mojibake(texts: pd.Series) -> pd.Series:
    """Text that was UTF-8 read as Windows-1252 repaired; anything else unchanged."""

    def fix(text):
        if text is None:
            return None
        try:
            return text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return text

    return texts.map(fix)


def split_jcr(text: str) -> list[str]:
    """Items of a bracketed or plain comma list; a backslash escapes the next character, blank items are dropped."""
    inner = text.removeprefix("[").removesuffix("]") if text.startswith("[") else text
    items, now, escaped = [], "", False
    for c in inner:
        if escaped:
            now, escaped = now + c, False
        elif c == "\\":
            escaped = True
        elif c == ",":
            items.append(now)
            now = ""
        else:
            now += c
    return [i.strip() for i in [*items, now] if i.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def jcr_list(texts: pd.Series) -> pd.Series:
    """Items of escaped comma lists."""
    return texts.map(lambda t: None if t is None else split_jcr(t))
