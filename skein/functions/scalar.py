"""Scalar functions and operators, with the language's own rules where Spark's differ.

All of them are built-in expressions but Unicode normalization and the JSON
functions that compare documents, which are pandas UDFs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.plans.parser import GqlError

from . import json_docs

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def guarded(bad: Column, message: str, value: Column, kind: str) -> Column:
    """``value``, or an error where ``bad`` holds; the guard stays inside the branch."""
    return F.when(bad, F.raise_error(F.lit(f"22023: {message}")).cast(kind)).otherwise(value)


def real(value: Column) -> Column:
    """A double result that must be finite."""
    v = value.cast("double")
    return guarded(F.isnan(v) | (F.abs(v) == float("inf")), "the result is not finite", v, "double")


def division(a: Column, b: Column, whole: bool) -> Column:
    """Integers truncate; a zero divisor is an error."""
    if whole:
        return F.call_function("div", a, b)
    return guarded(b == 0, "division by zero", a / b, "double")


def modulus(a: Column, b: Column, kind: T.DataType) -> Column:
    """Truncating remainder in the divisor's type."""
    return guarded(b == 0, "division by zero", (a % b).cast(kind), kind.simpleString())


def power(a: Column, b: Column) -> Column:
    bad = ((a == 0) & (b < 0)) | ((a < 0) & (b != F.floor(b)))
    return guarded(bad, "power outside its domain", real(F.pow(a, b)), "double")


def domain(name: str, f: Callable, good: Callable) -> Callable:
    return lambda x: guarded(~good(x), f"{name} outside its domain", real(f(x)), "double")


@F.pandas_udf(T.StringType())
def normalized(s: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize(f, x) for x, f in zip(s, form, strict=True)])


def left_of(x: Column, n: Column, binary: bool) -> Column:
    return F.substring(x, F.lit(1), n) if binary else F.left(x, n)


def right_of(x: Column, n: Column, binary: bool) -> Column:
    return F.substring(x, F.greatest(F.octet_length(x) - n + 1, F.lit(1)), n) if binary else F.right(x, n)


def trimmed(side: str, x: Column, chars: Column) -> Column:
    return {"BOTH": F.btrim, "LEADING": F.ltrim, "TRAILING": F.rtrim}[side](x, chars)


def shorter_list(x: Column, n: Column) -> Column:
    """Without the last n members."""
    bad = (n > F.size(x)) | (n < 0)
    return F.when(bad, F.raise_error(F.lit("22023: more members to drop than there are"))).otherwise(F.slice(x, F.lit(1), F.size(x) - n))


def uuid_of(x: Column) -> Column:
    ok = x.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
    return guarded(~ok, "not a UUID", F.lower(x), "string")


def uuid_v7() -> Column:
    """Milliseconds of the request in the first 48 bits, the rest at random."""
    now = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    rest = F.translate(F.uuid(), "-", "")
    return F.concat(F.substring(now, 1, 8), F.lit("-"), F.substring(now, 9, 4), F.lit("-7"), F.substring(rest, 14, 3), F.lit("-"), F.substring(rest, 17, 4), F.lit("-"), F.substring(rest, 21, 12))


ISO_DURATION = re.compile(r"([+-]?)P(?=.)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", re.IGNORECASE)
MONTHS_IN, SECONDS_IN = {"years": 12, "months": 1}, {"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1, "milliseconds": 1e-3, "microseconds": 1e-6, "nanoseconds": 1e-9}


def literal_duration(text: str) -> Column:
    """A duration that is known when the query is compiled: of months, of days to seconds, or of both."""
    m = ISO_DURATION.fullmatch(text.strip())
    if m is None:
        raise GqlError("not a duration", "22G03")
    sign = -1 if m[1] == "-" else 1
    years, months, weeks, days, hours, minutes = (sign * int(x or 0) for x in m.groups()[1:7])
    seconds = F.lit(("-" if sign < 0 else "") + (m[8] or "0")).cast("decimal(18,6)")
    if m[2] is None and m[3] is None:
        return F.make_dt_interval(F.lit(7 * weeks + days), F.lit(hours), F.lit(minutes), seconds)
    if all(x is None for x in m.groups()[3:]):
        return F.make_ym_interval(F.lit(years), F.lit(months))
    return F.make_interval(F.lit(years), F.lit(months), F.lit(weeks), F.lit(days), F.lit(hours), F.lit(minutes), seconds)


def duration(x: Column, dtype: T.DataType) -> Column:
    """A DAY TO SECOND duration from ISO text, PnWnDTnHnMn.nS; or one of the fields of a record, which are of one group."""
    if isinstance(dtype, T.StructType):
        names = {n.lower(): n for n in dtype.names}
        for known, made in ((MONTHS_IN, lambda v: F.make_ym_interval(F.lit(0), v.cast("int"))), (SECONDS_IN, lambda v: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), v.cast("decimal(18,6)")))):
            if names and set(names) <= set(known):
                parts = [x.getField(n).cast("decimal(28,9)") * F.lit(known[k]).cast("decimal(18,9)") for k, n in names.items()]
                return made(reduce(lambda a, b: a + b, parts))
        raise GqlError("a duration's fields are years and months, or days to nanoseconds", "22G03")
    part = lambda p: F.coalesce(F.nullif(F.regexp_extract(x, p, 1), F.lit("")).cast("double"), F.lit(0.0))
    seconds = part(r"^-?P.*?(\d+)W") * 604800 + part(r"^-?P.*?(\d+)D") * 86400 + part(r"T.*?(\d+)H") * 3600 + part(r"T(?:.*?\D)?(\d+)M") * 60 + part(r"T(?:.*?[A-Z])?([\d.]+)S")
    ok = x.rlike(r"^-?P(?=.)(\d+W)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?([\d.]+S)?)?$")
    made = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.when(x.startswith("-"), -seconds).otherwise(seconds)).cast("decimal(18,6)"))
    return F.when(x.isNotNull() & ~ok, F.raise_error(F.lit("22G03: not a duration of days to seconds")).cast("interval day to second")).otherwise(made)


def iso_duration(x: Column, dtype: T.DataType) -> Column:
    """ISO text of a duration; PT0S and P0M are the empty ones."""
    some = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    if isinstance(dtype, T.YearMonthIntervalType):
        months = F.call_function("extract", F.lit("YEAR"), x) * 12 + F.call_function("extract", F.lit("MONTH"), x)
        size = F.abs(months)
        body = F.concat(some(F.floor(size / 12), "Y"), some(size % 12, "M"))
        return F.when(months == 0, "P0M").otherwise(F.concat(F.when(months < 0, "-P").otherwise("P"), body))
    field = lambda unit: F.call_function("extract", F.lit(unit), x)
    days, hours, minutes, seconds = (F.abs(field(u)) for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
    clock = F.concat(some(hours, "H"), some(minutes, "M"), F.when(seconds != 0, F.concat(F.regexp_replace(F.regexp_replace(seconds.cast("string"), r"0+$", ""), r"\.$", ""), F.lit("S"))).otherwise(""))
    body = F.concat(some(days, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    below = (field("DAY") < 0) | (field("HOUR") < 0) | (field("MINUTE") < 0) | (field("SECOND") < 0)
    return F.when(x.isNull(), F.lit(None)).when(body == "", "PT0S").otherwise(F.concat(F.when(below, "-P").otherwise("P"), body))


INTERVALS = (T.YearMonthIntervalType, T.DayTimeIntervalType)


def date_moved(day: Column, by: Column, dtype: T.DataType, sign: int) -> Column:
    """A date stays one: of hours and seconds, whole days count."""
    if isinstance(dtype, T.YearMonthIntervalType):
        return (day + by) if sign > 0 else (day - by)
    days = F.call_function("extract", F.lit("DAY"), by.cast("interval day to second")).cast("int")
    return F.date_add(day, days * sign)


def duration_between(a: Column, b: Column, unit: str) -> Column:
    """From a to b; in whole months, or in days to seconds."""
    if unit == "months":
        # the most whole months from a that do not pass b, as the last day of a month is reached from later ones too
        near = F.call_function("months_between", b, a)
        near = F.when(near < 0, F.floor(near)).otherwise(F.ceil(near)).cast("int")
        reached = a + F.make_ym_interval(F.lit(0), near)
        months = F.when((near > 0) & (reached > b), near - 1).when((near < 0) & (reached < b), near + 1).otherwise(near)
        return F.make_ym_interval(F.lit(0), months)
    return (b.cast("timestamp") - a.cast("timestamp")).cast("interval day to second")


def time_of_day(x: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.call_function("to_time", x)
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType):
        return F.call_function("make_time", F.hour(x), F.minute(x), F.call_function("extract", F.lit("SECOND"), x))
    return x.cast("time")


def temporal(kind: str, args: list[Column], dtype: T.DataType) -> Column:
    """Temporal values from text, or from a record of fields."""
    x = args[0]
    if isinstance(dtype, T.StructType):
        have = {f.name.lower(): x.getField(f.name) for f in dtype.fields}
        get = lambda k, d: have.get(k, F.lit(d)).cast("int")
        day = (get("year", 1970), get("month", 1), get("day", 1))
        clock = (get("hour", 0), get("minute", 0), have.get("second", F.lit(0)).cast("decimal(8,6)"))
        if kind == "DATE":
            return F.make_date(*day)
        if "TIME" in kind and "DATETIME" not in kind and "TIMESTAMP" not in kind:
            return F.call_function("make_time", *clock)
        return F.call_function("make_timestamp" if "ZONED" in kind else "make_timestamp_ntz", *day, *clock)
    if kind == "DATE":
        return x.cast("date")
    if kind in ("TIME", "LOCAL_TIME"):
        return time_of_day(x, dtype)
    if kind == "ZONED_TIME":
        return F.struct(F.call_function("to_time", F.regexp_replace(x, r"(Z|[+-]\d\d:?\d\d)$", "")).alias("time"), F.regexp_extract(x, r"(Z|[+-]\d\d:?\d\d)$", 1).alias("offset"))
    if kind in ("ZONED_DATETIME", "TIMESTAMP"):
        return x.cast("timestamp")
    return x.cast("timestamp_ntz")


#: Functions of one number whose domain is all reals, or that state it.
NUMERIC: dict[str, Callable] = {
    "SIN": lambda x: real(F.sin(x)), "COS": lambda x: real(F.cos(x)), "TAN": lambda x: real(F.tan(x)),
    "COT": domain("COT", F.cot, lambda x: F.tan(x) != 0),
    "SINH": lambda x: real(F.sinh(x)), "COSH": lambda x: real(F.cosh(x)), "TANH": lambda x: real(F.tanh(x)),
    "ASIN": domain("ASIN", F.asin, lambda x: F.abs(x) <= 1), "ACOS": domain("ACOS", F.acos, lambda x: F.abs(x) <= 1), "ATAN": lambda x: real(F.atan(x)),
    "DEGREES": lambda x: real(F.degrees(x)), "RADIANS": lambda x: real(F.radians(x)),
    "LN": domain("LN", F.ln, lambda x: x > 0), "LOG10": domain("LOG10", F.log10, lambda x: x > 0), "EXP": lambda x: real(F.exp(x)),
    "SQRT": domain("SQRT", F.sqrt, lambda x: x >= 0),
    "ABS": F.abs, "CEIL": F.ceil, "CEILING": F.ceil, "FLOOR": F.floor,
}

NOW: dict[str, Callable] = {
    "CURRENT_DATE": F.current_date,
    "CURRENT_TIME": lambda: F.call_function("current_time"),
    "CURRENT_TIMESTAMP": F.current_timestamp,
    "LOCAL_TIMESTAMP": F.localtimestamp,
    "LOCAL_TIME": lambda: F.call_function("current_time"),
}

TEMPORAL = {"DATE", "TIME", "LOCAL_TIME", "ZONED_TIME", "DATETIME", "LOCAL_DATETIME", "ZONED_DATETIME", "TIMESTAMP"}


def call(name: str, args: list[Column], types: list[T.DataType], paths: list[bool]) -> Column:
    """A scalar function by name. paths: which arguments are paths."""
    binary = bool(types) and isinstance(types[0], T.BinaryType)
    n = len(args)

    def need(*counts: int) -> None:
        if n not in counts:
            raise GqlError(f"{name} takes {' or '.join(map(str, counts))} arguments, not {n}")

    if name in NUMERIC:
        need(1)
        return NUMERIC[name](args[0])
    if name in TEMPORAL:
        need(1)
        return temporal(name, args, types[0])
    if name.startswith("JSON") and name in json_docs.FUNCTIONS:
        return json_docs.FUNCTIONS[name](args, types)
    if name == "LOG":
        need(1, 2)
        x = args[-1]
        value = F.ln(x) if n == 1 else F.ln(x) / F.ln(args[0])
        bad = x <= 0 if n == 1 else (x <= 0) | (args[0] <= 0) | (args[0] == 1)
        return guarded(bad, "LOG outside its domain", real(value), "double")
    if name == "MOD":
        need(2)
        return modulus(args[0], args[1], types[1])
    if name == "POWER":
        need(2)
        return power(*args)
    if name in ("CHAR_LENGTH", "CHARACTER_LENGTH"):
        need(1)
        return F.char_length(args[0]).cast("long")
    if name in ("BYTE_LENGTH", "OCTET_LENGTH"):
        need(1)
        if not binary:
            raise GqlError(f"{name} takes bytes", "22G03")
        return F.octet_length(args[0]).cast("long")
    if name in ("LEFT", "RIGHT"):
        need(2)
        return (left_of if name == "LEFT" else right_of)(args[0], args[1].cast("int"), binary)
    if name in ("BTRIM", "LTRIM", "RTRIM"):
        need(1, 2)
        side = {"B": "BOTH", "L": "LEADING", "R": "TRAILING"}[name[0]]
        return trimmed(side, args[0], args[1] if n > 1 else F.lit(" "))
    if name in ("UPPER", "LOWER"):
        need(1)
        return F.upper(args[0]) if name == "UPPER" else F.lower(args[0])
    if name == "COALESCE":
        if n < 2:
            raise GqlError("COALESCE takes two arguments at least")
        return F.coalesce(*args)
    if name == "NULLIF":
        need(2)
        return F.nullif(*args)
    if name == "SIZE":
        need(1)
        return F.size(args[0]).cast("long")
    if name == "CARDINALITY":
        need(1)
        if paths[0]:
            return (F.size(args[0].getField("edges")) * 2 + 1).cast("long")
        if isinstance(types[0], T.StructType):
            return F.lit(len(types[0].fields)).cast("long")
        return F.size(args[0]).cast("long")
    if name == "PATH_LENGTH":
        need(1)
        return F.size(args[0].getField("edges")).cast("long")
    if name == "ELEMENTS":
        need(1)
        nodes, edges = args[0].getField("nodes"), args[0].getField("edges")
        pairs = F.flatten(F.transform(edges, lambda e, i: F.array(e, F.element_at(nodes, (i + 2).cast("int")))))
        return F.concat(F.slice(nodes, 1, 1), pairs)
    if name == "DURATION":
        need(1)
        return duration(args[0], types[0])
    if name == "UUID_V4":
        need(0)
        return F.uuid()
    if name == "UUID_V7":
        need(0)
        return uuid_v7()
    if name == "UUID":
        need(1)
        return uuid_of(args[0])
    if name in ("SAME", "ALL_DIFFERENT"):
        if n < 2:
            raise GqlError(f"{name} takes two arguments at least")
        out: Any = F.lit(True)
        for i in range(n):
            for j in range(i + 1, n):
                out = out & ((args[i] == args[j]) if name == "SAME" else (args[i] != args[j]))
        missing = F.lit(False)
        for a in args:
            missing = missing | a.isNull()
        return guarded(missing, f"{name} of a null", out, "boolean")
    if name.startswith("VECTOR"):
        from .vectors import FUNCTIONS

        if name in FUNCTIONS:
            return FUNCTIONS[name](*args)
    raise GqlError(f"there is no function {name}", "42N02")


#: Declared types that need no arguments.
TYPES = {
    "BOOL": "boolean", "BOOLEAN": "boolean", "INT8": "tinyint", "INTEGER8": "tinyint", "INT16": "smallint", "INTEGER16": "smallint", "SMALLINT": "smallint",
    "INT32": "int", "INTEGER32": "int", "INT64": "long", "INTEGER64": "long", "INT": "long", "INTEGER": "long", "BIGINT": "long",
    "UINT8": "smallint", "UINT16": "int", "UINT32": "long", "UINT64": "decimal(20,0)", "UINT": "decimal(20,0)", "INT128": "decimal(38,0)", "UINT128": "decimal(38,0)",
    "FLOAT": "double", "FLOAT64": "double", "DOUBLE": "double", "FLOAT32": "float", "REAL": "float", "STRING": "string", "CHAR": "string", "VARCHAR": "string",
    "BYTES": "binary", "BINARY": "binary", "VARBINARY": "binary", "DATE": "date", "TIME": "time", "LOCAL_TIME": "time", "TIMESTAMP": "timestamp",
    "ZONED_DATETIME": "timestamp", "LOCAL_DATETIME": "timestamp_ntz", "DURATION": "interval day to second", "UUID": "string", "VECTOR": "array<float>", "JSON": "string",
}

#: Least and greatest value of unsigned types.
UNSIGNED = {"UINT8": (1 << 8) - 1, "UINT16": (1 << 16) - 1, "UINT32": (1 << 32) - 1, "UINT64": (1 << 64) - 1, "UINT": (1 << 64) - 1}


def spark_type(kind: tuple) -> str:
    name, args = kind
    if name == "DURATION" and "months" in args:
        return "interval year to month"
    if name in ("DECIMAL", "NUMERIC", "DEC"):
        return f"decimal({args[0] if args else 38},{args[1] if len(args) > 1 else 10 if not args else 0})"
    if name == "RECORD":
        return "struct<" + ",".join(f"`{n}`:{spark_type(t)}" for n, t in args if isinstance(n, str)) + ">"
    if name in ("LIST", "ARRAY"):
        return f"array<{spark_type(args[0]) if args else 'string'}>"
    if name not in TYPES:
        raise GqlError(f"unknown type {name}")
    return TYPES[name]


def cast(x: Column, kind: tuple, dtype: T.DataType) -> Column:
    name, args = kind
    to = spark_type(kind)
    if name == "JSON":
        return json_docs.parsed(x) if isinstance(dtype, T.StringType) else F.to_json(x)
    if isinstance(dtype, INTERVALS) and to == "string":
        return iso_duration(x, dtype)
    if to == "time":
        return time_of_day(x, dtype)
    if name == "DURATION":
        if isinstance(dtype, INTERVALS):
            return x.cast(to)
        return duration(x, dtype)
    if isinstance(dtype, T.StringType) and name in TYPES and name.startswith(("INT", "UINT", "BIGINT", "SMALLINT")):
        text = F.translate(F.btrim(x), "_", "")
        body = F.regexp_replace(text, r"^([+-]?)0[xXoObB]", "$1")
        base = F.when(text.rlike(r"^[+-]?0[xX]"), F.conv(body, 16, 10)).when(text.rlike(r"^[+-]?0[oO]"), F.conv(body, 8, 10)).when(text.rlike(r"^[+-]?0[bB]"), F.conv(body, 2, 10)).otherwise(text)
        out = base.cast(to)
    elif isinstance(dtype, FLOATING) and to in ("long", "int", "smallint", "tinyint"):
        out = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast(to)
    else:
        out = x.cast(to)
    if name in UNSIGNED:
        out = guarded((out < 0) | (out > F.lit(UNSIGNED[name]).cast("decimal(20,0)")), f"outside {name}", out, to)
    if name in ("CHAR", "VARCHAR") and args:
        out = guarded(F.char_length(out) > args[-1], f"longer than {args[-1]} characters", out, "string")
    return out
