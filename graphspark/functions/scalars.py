"""Units, dates, canonical JSON and other scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kilowatts(text: Column) -> Column:
    """15.5kW, 15500 W and 15500W as kilowatts; null if it isn't a power."""
    number = F.expr("1") * F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:kW|W)\s*$", 1).try_cast("decimal(18,6)")
    return F.when(text.rlike(r"kW\s*$"), number).when(text.rlike(r"W\s*$"), number / 1000).cast("decimal(18,6)")


def any_date(text: Column) -> Column:
    """2026/3/21, 2026-03-21 and 26年3月21日 as a date; null if none of them."""
    short = F.regexp_replace(text, r"^(\d{2})年(\d{1,2})月(\d{1,2})日$", "20$1-$2-$3")
    return F.coalesce(F.try_to_date(short, "yyyy/M/d"), F.try_to_date(short, "yyyy-M-d"))


def sorted_struct(value: Column, kind: T.DataType) -> Column:
    """A value with the fields of every struct in it in alphabetical order."""
    if isinstance(kind, T.StructType):
        names = sorted(kind.fieldNames())
        return F.struct(*[sorted_struct(value[n], kind[n].dataType).alias(n) for n in names])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda x: sorted_struct(x, kind.elementType))
    return value


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON with sorted keys and compact separators."""
    return F.to_json(sorted_struct(value, kind), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def safe_path(path: Column) -> Column:
    """A relative path in its plainest form: no step to the same or the upper folder, no
    empty step, no space around it, no backslash, NUL or line end."""
    stripped = F.regexp_replace(path, r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", "")
    steps = F.split(path, "/")
    return (path == stripped) & ~path.rlike(r"[\\\x00\r\n]") & ~F.exists(steps, lambda x: x.isin("", ".", ".."))


def under_root(uri: Column, root: Column) -> Column:
    return (uri == root) | uri.startswith(F.concat(root, F.lit("/")))


def ordered_prefix(items: Column, model: Column) -> Column:
    """Whether a list is a prefix of the ordered model."""
    return (F.size(items) <= F.size(model)) & F.when(F.size(items) > 0, F.slice(model, F.lit(1), F.size(items)) == items).otherwise(True)
