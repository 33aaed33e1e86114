"""Column functions on text, all JVM-side built-ins (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# the characters regex \s stands for: blank, tab, newline, vertical tab,
# form feed, carriage return
WHITE_SPACE = " \t\n\x0b\f\r"


def trim_ws(c) -> Column:
    """Strip all leading and trailing white space (``trim`` strips blanks
    only); ``btrim`` with the white-space set, no regular expression."""
    return F.btrim(_c(c), F.lit(WHITE_SPACE))


def collapse_ws(c, max_len: int | None = None) -> Column:
    """Trim, turn tabs and newlines into blanks, collapse runs of blanks;
    optionally cut to ``max_len`` characters and append '...'."""
    flat = F.regexp_replace(trim_ws(c), r"[ \t\n]+", " ")
    if max_len is None:
        return flat
    return F.when(F.length(flat) > max_len,
                  F.concat(F.substring(flat, 1, max_len), F.lit("..."))).otherwise(flat)


def cut(c, max_len: int) -> Column:
    """Cut to ``max_len`` characters including a trailing '...'."""
    c = _c(c)
    return F.when(F.length(c) > max_len,
                  F.concat(F.substring(c, 1, max_len - 3), F.lit("..."))).otherwise(c)


def checksum16(c) -> Column:
    """First 16 hex digits of SHA-256 of the trimmed text."""
    return F.substring(F.sha2(trim_ws(c), 256), 1, 16)


def hex_prefix16(c) -> Column:
    """Hex of the first 8 bytes of the UTF-8 text (shorter text: all bytes)."""
    return F.lower(F.substring(F.hex(F.encode(_c(c), "UTF-8")), 1, 16))


def namespace(c, prefix: str = "branch_") -> Column:
    """Branch name -> namespace: '/', '-', '.', ' ' become '_', lower case."""
    return F.concat(F.lit(prefix), F.lower(F.translate(_c(c), "/-. ", "____")))


def short_id(c, n: int = 8) -> Column:
    return F.substring(_c(c), 1, n)


def ntz_micros(c) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp without time zone,
    from its calendar fields: the same in every session time zone (a cast to
    an instant is not: local times in a daylight-saving gap move)."""
    c = _c(c)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    whole = days * 86400 + F.hour(c).cast("bigint") * 3600 + F.minute(c).cast("bigint") * 60
    return whole * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def age_text(ts, ref) -> Column:
    """'just now' / 'Nm ago' / 'Nh ago' / 'Nd ago' of ``ts`` seen at ``ref``
    (both timestamps without time zone, compared by their wall clocks)."""
    secs = ((ntz_micros(ref) - ntz_micros(ts)) / 1_000_000).cast("bigint")
    return (F.when(secs < 60, F.lit("just now"))
             .when(secs < 3600, F.concat((secs / 60).cast("bigint").cast("string"), F.lit("m ago")))
             .when(secs < 86400, F.concat((secs / 3600).cast("bigint").cast("string"), F.lit("h ago")))
             .otherwise(F.concat((secs / 86400).cast("bigint").cast("string"), F.lit("d ago"))))


def sequence_name(default_expr) -> Column:
    """Sequence name inside a ``nextval('schema.name'::regclass)`` default:
    the text between the first and last quote, after its last dot."""
    inner = F.regexp_extract(_c(default_expr), r"'(.*)'", 1)
    return F.regexp_extract(inner, r"([^.]*)$", 1)


def requalify_sequence(default_expr, ns) -> Column:
    """Point an identity default at the same sequence in namespace ``ns``."""
    d = _c(default_expr)
    name = sequence_name(d)
    return (F.when(d.contains("nextval(") & (name != ""),
                   F.concat(F.lit("nextval('"), _c(ns), F.lit("."), name, F.lit("'::regclass)")))
             .otherwise(d))
