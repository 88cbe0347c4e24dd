"""Canonical text. NFC has no built-in, so texts go through one Arrow function; all else is in it already."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NORMALIZER_VERSION = "nfc-lines/1"

#: Fenced code: its first line, what it holds, and the line that closes it, or the end of the text.
_FENCED = re.compile(r"^([^\S\n]*(`{3,}+|~{3,}+)[^\n]*)(\n?)(.*?)(^[^\S\n]*\2[^\n]*|\Z)", re.M | re.S)
_LINE_ENDS = re.compile(r"[^\S\n]+$", re.M)


def canonical(text: str) -> str:
    """NFC, LF line ends, no white space at line ends but inside fenced code, at most one blank line, none at the ends."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    if "\r" in text:
        text = re.sub(r"\r\n?", "\n", text)
    bare, at = [], 0
    for m in _FENCED.finditer(text):
        bare += [_LINE_ENDS.sub("", text[at : m.start()]), m[1].rstrip(), m[3], m[4], m[5].rstrip()]
        at = m.end()
    bare.append(_LINE_ENDS.sub("", text[at:]))
    return re.sub(r"\n{3,}", "\n\n", "".join(bare)).strip("\n")


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else canonical(t))
