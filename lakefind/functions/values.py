"""Dates, addresses and patterns: how literals are read, and the column forms."""

from __future__ import annotations

import ipaddress
import re
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParseError

_DAY = re.compile(r"(\d{4})-?(\d\d)-?(\d\d)")


def parse_date(text: str) -> datetime:
    """A UTC time from RFC 3339, ``YYYY-MM-DD`` or ``YYYYMMDD``; without an offset it is UTC."""
    s = text.strip()
    try:
        if m := _DAY.fullmatch(s):
            return datetime(*map(int, m.groups()), tzinfo=UTC)
        if not re.match(r"\d{4}-\d\d-\d\d[T ]", s):
            raise ValueError("not a date")
        t = datetime.fromisoformat(s)
        return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
    except ValueError as e:
        raise QueryParseError(f"invalid date '{text}'") from e


def date_literal(t: datetime, kind: T.DataType) -> Column:
    """A literal that compares with a column of this date type without a cast."""
    plain = t.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestamp_ntz'{plain}'")
    if isinstance(kind, T.DateType) and (t.hour, t.minute, t.second, t.microsecond) == (0, 0, 0, 0):
        return F.expr(f"date'{plain[:10]}'")
    return F.expr(f"timestamp'{plain}+00:00'")


def to_timestamp(text: Column) -> Column:
    """The time that a string column holds, in the formats of :func:`parse_date`; null if it has none."""
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(F.concat(text, F.lit("+00:00")), F.lit("yyyyMMddxxx")))
    plain = text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d.*)?$")
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$") & text.rlike(r"[T ]")
    whole = F.when(zoned, text).when(text.rlike(r"[T ]"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z")))
    return F.coalesce(compact, F.when(plain, F.try_to_timestamp(whole)))


def parse_ip(text: str) -> str:
    """An address in its IPv6 form as 32 hexadecimal digits; IPv4 is mapped."""
    try:
        a = ipaddress.ip_address(text)
    except ValueError as e:
        raise QueryParseError(f"invalid ip '{text}'") from e
    return f"{int(a) | (0xFFFF << 32):032x}" if a.version == 4 else f"{int(a):032x}"


def _ip_or_none(text: str | None) -> str | None:
    try:
        return None if text is None else parse_ip(text)
    except QueryParseError:
        return None


@F.pandas_udf(T.StringType())
def ip_key(text: pd.Series) -> pd.Series:
    """:func:`parse_ip` of a string column; null for what is no address."""
    known = {t: _ip_or_none(t) for t in text.dropna().unique()}
    return text.map(known).astype(object).where(text.notna(), None)


_META = set(".^$|()[]{}*+?\\/-&~#")


def escape(text: str) -> str:
    """A regular expression that matches just this text, in Java and RE2."""
    return "".join(f"\\{c}" if c in _META else c for c in text)


def wildcard_regex(pattern: str) -> str:
    """The anchored expression of a pattern: ``*`` any text, ``?`` one character, ``\\x`` a plain x."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(escape(pattern[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or escape(c))
        i += 1
    return f"^(?s:{''.join(out)})\\z"
