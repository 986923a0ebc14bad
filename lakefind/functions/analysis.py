"""Analyzers: how a string becomes tokens.

``raw`` keeps the whole string.  ``simple`` lower-cases and takes the runs of
letters and digits of at most 40 characters; it is a JVM expression.
``en_stem`` is ``simple`` followed by the English stemmer, which needs Python: a
batch's distinct tokens are stemmed once each.  An index stores its stemmed
tokens, so no search runs the stemmer over the corpus.

Tokens over 40 characters are left out of the index and of queries alike: so does
the analyzer of the reference, and a test pins it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemmer import beginning, stem

ANALYZERS = ("raw", "simple", "en_stem")
#: Longer tokens are dropped.
MAX_TOKEN = 40
_WORD = re.compile(r"[^\W_]+")


def analyze(text: str, analyzer: str) -> list[str]:
    """The tokens of a query's text."""
    if analyzer == "raw":
        return [text]
    words = [w for w in _WORD.findall(text.lower()) if len(w) <= MAX_TOKEN]
    return [stem(w) for w in words] if analyzer == "en_stem" else words


def letters(token: str, analyzer: str) -> str:
    """What a lower-cased text with the token is sure to have; empty if nothing is."""
    return {"simple": token, "en_stem": beginning(token)}.get(analyzer, "")


def simple_tokens(text: Column) -> Column:
    """The ``simple`` tokens of a string column; null for null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(text.isNotNull(), F.filter(words, lambda w: F.length(w) <= MAX_TOKEN))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pa.Array) -> pa.Array:
    flat = tokens.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    lengths = np.append(0, np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    mask = tokens.is_null() if tokens.null_count else None
    return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), stems.take(flat.indices), mask=mask)


def tokens(text: Column, analyzer: str, many: bool = False) -> Column:
    """The tokens of a string column, or of an array of strings one after the other."""
    if analyzer == "raw":
        return text if many else F.when(text.isNotNull(), F.array(text))
    words = F.flatten(F.transform(F.filter(text, lambda x: x.isNotNull()), simple_tokens)) if many else simple_tokens(text)
    return _stemmed(words) if analyzer == "en_stem" else words
