"""Column functions. All are built from native expressions and stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pct_to_double(c: Column) -> Column:
    """``'1.5%'`` -> 1.5, dropping every percent sign; null when no number is left."""
    return F.replace(c, F.lit("%"), F.lit("")).try_cast("double")


def trailing_pct_to_double(c: Column) -> Column:
    """Like :func:`pct_to_double` but only trailing percent signs are dropped."""
    return F.regexp_replace(c, "%+$", "").try_cast("double")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_long(c: Column) -> Column:
    return c.try_cast("bigint")


def epoch_to_timestamp(c: Column) -> Column:
    return F.timestamp_seconds(c)


def epoch_to_date(c: Column) -> Column:
    """Epoch seconds to a day, in the session zone (UTC)."""
    return F.to_date(F.timestamp_seconds(c))


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 text; the fraction shows only when it is not zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction))


def day_string(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def parse_day(c: Column) -> Column:
    """Text to a day; null where it does not parse."""
    return c.try_cast("date")


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def contains_ci(c: Column, word: Column | str) -> Column:
    """Case-insensitive literal substring test."""
    word = word if isinstance(word, Column) else F.lit(word)
    return F.contains(F.lower(c), F.lower(word))


def truncate_ellipsis(c: Column, n: int) -> Column:
    """The first ``n`` characters and ``...`` when the text is longer than ``n``."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def has_suffix(c: Column, s: str) -> Column:
    return c.endswith(s)


def has_prefix(c: Column, s: str) -> Column:
    return c.startswith(s)


def round2(c: Column) -> Column:
    return F.round(c, 2)


def symbol_checksum(c: Column) -> Column:
    """Sum of the code points of a symbol."""
    letters = F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda acc, ch: acc + F.ascii(ch))


def lookup(m: Column, key: str, default: Column | None = None) -> Column:
    """Map value; ``default`` only where the key is absent. An explicit null stays null."""
    found = F.try_element_at(m, F.lit(key))
    if default is None:
        return found
    return F.when(F.map_contains_key(m, F.lit(key)), found).otherwise(default)


def default_if_missing(m: Column, key: str, default: object) -> Column:
    return lookup(m, key, default if isinstance(default, Column) else F.lit(default))


def json_dump(c: Column) -> Column:
    return F.to_json(c)


def nested_field(c: Column, *path: str) -> Column:
    """Null-safe walk into nested structs."""
    return reduce(lambda col, name: col.getField(name), path, c)


def template(fmt: str, *cols: Column) -> Column:
    """``%s`` placeholders filled by columns; a null column gives a null text."""
    pieces = fmt.split("%s")
    if len(pieces) != len(cols) + 1:
        raise ValueError("one column per %s")
    parts = [F.lit(pieces[0])]
    for col, piece in zip(cols, pieces[1:]):
        parts += [col.cast(T.StringType()), F.lit(piece)]
    return F.concat(*parts)


def session_key(*cols: Column) -> Column:
    """A random key, or a repeatable one when columns are given."""
    return F.sha2(F.concat_ws(":", *cols), 256) if cols else F.uuid()
