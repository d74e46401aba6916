"""JSON functions on documents held as text.

Lookups are built-in expressions over VARIANT; what compares or rewrites whole
documents (containment, merge patch, patch) is a pandas UDF.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.plans.parser import GqlError


def parsed(x: Column) -> Column:
    """Checked text, with keys in order."""
    return F.to_json(F.parse_json(x))


def contains(a: Any, b: Any) -> bool:
    """Objects contain their parts, arrays some member for each, and an array contains a scalar that is a member."""
    if isinstance(a, dict):
        return isinstance(b, dict) and all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        if isinstance(b, list):
            return all(any(contains(x, y) for x in a) for y in b)
        return not isinstance(b, dict) and any(same(x, b) for x in a)
    return not isinstance(b, dict | list) and same(a, b)


def same(a: Any, b: Any) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def merge_patch(target: Any, patch: Any) -> Any:
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def patch(doc: Any, steps: list) -> Any:
    """RFC 6902."""
    doc = json.loads(json.dumps(doc))

    def keys(pointer: str) -> list[str]:
        return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]

    def at(path: list[str]) -> Any:
        here = doc
        for k in path:
            here = here[int(k)] if isinstance(here, list) else here[k]
        return here

    def put(path: list[str], value: Any, replace: bool = False) -> None:
        nonlocal doc
        if not path:
            doc = value
            return
        here, k = at(path[:-1]), path[-1]
        if isinstance(here, list):
            i = len(here) if k == "-" else int(k)
            if replace:
                here[i] = value
            elif i > len(here):
                raise IndexError(k)
            else:
                here.insert(i, value)
        elif replace and k not in here:
            raise KeyError(k)
        else:
            here[k] = value

    def take(path: list[str]) -> Any:
        here, k = at(path[:-1]), path[-1]
        return here.pop(int(k)) if isinstance(here, list) else here.pop(k)

    for s in steps:
        op, path = s["op"], keys(s["path"])
        if op == "test":
            if not same(at(path), s["value"]):
                raise ValueError("a test of the patch failed")
        elif op == "remove":
            take(path)
        elif op in ("add", "replace"):
            put(path, s["value"], op == "replace")
        elif op == "copy":
            put(path, json.loads(json.dumps(at(keys(s["from"])))))
        elif op == "move":
            put(path, take(keys(s["from"])))
        else:
            raise ValueError(f"unknown step {op}")
    return doc


def text(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def _two(a: pd.Series, b: pd.Series, f) -> list:
    return [None if x is None or y is None else f(json.loads(x), json.loads(y)) for x, y in zip(a, b, strict=True)]


@F.pandas_udf(T.BooleanType())
def contains_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_two(a, b, contains), dtype=object)


@F.pandas_udf(T.StringType())
def merge_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_two(a, b, lambda x, y: text(merge_patch(x, y))), dtype=object)


@F.pandas_udf(T.StringType())
def patch_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_two(a, b, lambda x, y: text(patch(x, y))), dtype=object)


def member(x: Column, key: Column, kind: T.DataType) -> Column:
    """The member of an object by key, or of an array by place (from the end if negative), as a VARIANT."""
    v = F.parse_json(x)
    if isinstance(kind, T.StringType):
        return F.variant_get(v, F.concat(F.lit("$['"), key, F.lit("']")), "variant")
    place = F.when(key < 0, F.json_array_length(x) + key).otherwise(key)
    return F.when(place >= 0, F.variant_get(v, F.concat(F.lit("$["), place.cast("string"), F.lit("]")), "variant"))


def by_path(x: Column, selectors: list[Column], kinds: list[T.DataType]) -> Column:
    """The value at a path of keys and places, as a VARIANT."""
    if len(selectors) > 64:
        raise GqlError("a path has 64 selectors at most", "22G03")
    if len(selectors) == 1 and isinstance(kinds[0], T.StringType):
        s = selectors[0]
        # a document '["a", 0]' or a JSONPath; a plain key otherwise
        steps = F.from_json(s, "array<string>")
        made = F.concat(F.lit("$"), F.array_join(F.transform(steps, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("['"), p, F.lit("']")))), ""))
        path = F.when(s.startswith("$"), s).when(s.startswith("["), made).otherwise(F.concat(F.lit("$['"), s, F.lit("']")))
        return F.variant_get(F.parse_json(x), path, "variant")
    out = x
    for s, k in zip(selectors, kinds, strict=True):
        last = member(out, s, k)
        out = F.to_json(last)
    return F.parse_json(out)


def shown(v: Column) -> Column:
    return F.to_json(v)


def as_text(v: Column) -> Column:
    """Strings as they are, other values as JSON; JSON null is null."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.variant_get(v, F.lit("$"), "string")).when(kind != "VOID", F.to_json(v))


def as_scalar(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.raise_error(F.lit("22G03: not a scalar")).cast("string")).otherwise(as_text(v))


def type_of(x: Column) -> Column:
    kind = F.schema_of_variant(F.parse_json(x))
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "number")
    )


def json_object(args: list[Column]) -> Column:
    if len(args) % 2:
        raise GqlError("json_object takes keys and values")
    return parsed(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), one_value(v)) for k, v in zip(args[::2], args[1::2], strict=True)]), F.lit("}")))


def one_value(v: Column) -> Column:
    wrapped = F.to_json(F.array(v))
    return wrapped.substr(F.lit(2), F.length(wrapped) - 2)


FUNCTIONS = {
    "JSON": lambda a, t: parsed(a[0]),
    "JSON_PARSE": lambda a, t: parsed(a[0]),
    "JSON_STRINGIFY": lambda a, t: parsed(a[0]),
    "JSON_TYPE": lambda a, t: type_of(a[0]),
    "JSON_ARRAY": lambda a, t: F.concat(F.lit("["), F.concat_ws(",", *map(one_value, a)), F.lit("]")),
    "JSON_OBJECT": lambda a, t: json_object(a),
    "JSON_ARRAY_LENGTH": lambda a, t: F.json_array_length(a[0]).cast("long"),
    "JSON_OBJECT_KEYS": lambda a, t: F.json_object_keys(a[0]),
    "JSON_CONTAINS": lambda a, t: contains_udf(a[0], a[1]),
    "JSON_MERGE_PATCH": lambda a, t: merge_udf(a[0], a[1]),
    "JSON_PATCH": lambda a, t: patch_udf(a[0], a[1]),
    "JSON_GET": lambda a, t: shown(member(a[0], a[1], t[1])),
    "JSON_GET_TEXT": lambda a, t: as_text(member(a[0], a[1], t[1])),
    "JSON_GET_SCALAR": lambda a, t: as_scalar(member(a[0], a[1], t[1])),
    "JSON_GET_PATH": lambda a, t: shown(by_path(a[0], a[1:], t[1:])),
    "JSON_GET_PATH_TEXT": lambda a, t: as_text(by_path(a[0], a[1:], t[1:])),
    "JSON_GET_PATH_SCALAR": lambda a, t: as_scalar(by_path(a[0], a[1:], t[1:])),
    "JSON_HAS_PATH": lambda a, t: by_path(a[0], a[1:], t[1:]).isNotNull(),
}
