"""Functions that Spark lacks altogether, on Arrow batches."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def compress(x: pd.Series) -> pd.Series:
    """COMPRESS: zlib of the text in UTF-8; null stays null."""
    return x.map(lambda v: None if v is None else zlib.compress(v.encode()))


@F.pandas_udf(T.StringType())
def decompress(x: pd.Series) -> pd.Series:
    """DECOMPRESS: null for what zlib cannot read."""

    def one(v):
        try:
            return None if v is None else zlib.decompress(v).decode()
        except (zlib.error, UnicodeDecodeError):
            return None

    return x.map(one)


def _metaphone(word: str) -> str:
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return ""
    for head, put in (("KN", "N"), ("GN", "N"), ("PN", "N"), ("AE", "E"), ("WR", "R"), ("WH", "W"), ("X", "S")):
        if w.startswith(head):
            w = put + w[len(head) :]
            break
    out: list[str] = []
    front = "EIY"
    for i, c in enumerate(w):
        before, after = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        two = w[i + 2] if i + 2 < len(w) else ""
        if c == before and c != "C":
            continue
        if c in "AEIOU":
            out.append(c if i == 0 else "")
        elif c == "B":
            out.append("" if before == "M" and not after else "B")
        elif c == "C":
            out.append("X" if after == "H" or (after == "I" and two == "A") else "" if before == "S" and after and after in front else "S" if after and after in front else "K")
        elif c == "D":
            out.append("J" if after == "G" and two and two in front else "T")
        elif c == "G":
            silent = (after == "H" and two and two not in "AEIOU") or (after == "N" and i + 2 >= len(w)) or before == "D" and after and after in front
            out.append("" if silent else "J" if after and after in front and before != "G" else "K")
        elif c == "H":
            out.append("H" if after and after in "AEIOU" and before not in ("C", "S", "P", "T", "G") else "")
        elif c == "K":
            out.append("" if before == "C" else "K")
        elif c == "P":
            out.append("F" if after == "H" else "P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            out.append("X" if after == "H" or (after == "I" and two in ("O", "A")) else "S")
        elif c == "T":
            out.append("X" if after == "I" and two in ("O", "A") else "0" if after == "H" else "" if after == "C" and two == "H" else "T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            out.append(c if after and after in "AEIOU" else "")
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
    return "".join(out)


@F.pandas_udf(T.StringType())
def metaphone(x: pd.Series) -> pd.Series:
    """METAPHONE: the classic consonant code of a word."""
    return x.map(lambda v: None if v is None else _metaphone(v))
