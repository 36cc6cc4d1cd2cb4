"""The metadata filter language, compiled to a Column over a struct, a JSON string or a VARIANT.

A filter is ``{"$and": [...]}``, ``{"$or": [...]}`` or ``{path: {op: value}}`` with one path and one op of $eq, $ne,
$in, $gt, $gte, $lt, $lte. Paths are dotted and walk objects only. A field that is missing, or of another type than
the operand where order is asked for, makes the predicate false (also $ne); an explicit null is a value.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidFilter

OPS = ("$eq", "$ne", "$in", "$gt", "$gte", "$lt", "$lte")
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"


def validate(spec: Any) -> None:
    """Raise InvalidFilter unless spec is a filter."""
    if not isinstance(spec, dict) or not spec:
        raise InvalidFilter("invalid filter: an object with one field or $and/$or is expected")
    for key in ("$and", "$or"):
        if key in spec:
            if not isinstance(spec[key], list):
                raise InvalidFilter(f"invalid filter: {key} takes a list")
            for x in spec[key]:
                validate(x)
            return
    if len(spec) != 1:
        raise InvalidFilter("invalid filter: one field at a time")
    ((path, test),) = spec.items()
    if not isinstance(test, dict) or len(test) != 1:
        raise InvalidFilter(f"invalid filter: {path!r} takes one operator")
    ((op, value),) = test.items()
    if op not in OPS:
        raise InvalidFilter(f"invalid filter: unknown operator {op!r}")
    if op == "$in" and not isinstance(value, list):
        raise InvalidFilter("invalid filter: $in takes a list")


class _Variant:
    def __init__(self, payload: Column, path: str, strict: bool):
        steps = "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in path.split("."))
        self.payload, self.path, self.strict = payload, "$" + steps, strict
        self.value = F.try_variant_get(payload, self.path, "variant")
        self.tag = F.schema_of_variant(self.value)

    def exists(self) -> Column:
        return self.value.isNotNull()

    def _as(self, kind: str) -> Column:
        return F.try_variant_get(self.payload, self.path, kind)

    def equal(self, x: Any) -> Column:
        if x is None:
            return F.is_variant_null(self.value)
        if isinstance(x, bool):
            return (self.tag == "BOOLEAN") & (self._as("boolean") == x)
        if isinstance(x, (int, float)):
            kind = (self.tag == "BIGINT" if isinstance(x, int) else self.tag.rlike(r"^(DOUBLE|DECIMAL.*)$")) if self.strict else self.tag.rlike(_NUMBER)
            return kind & (self._as("double") == float(x))
        if isinstance(x, str):
            return (self.tag == "STRING") & (self._as("string") == x)
        return F.to_json(self.value) == json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def ordered(self, op: str, x: Any) -> Column:
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return self.tag.rlike(_NUMBER) & _compare(op, self._as("double"), float(x))
        if isinstance(x, str):
            return (self.tag == "STRING") & _compare(op, self._as("string"), x)
        return F.lit(False)


class _Typed:
    """A field of a struct with a known type."""

    def __init__(self, payload: Column, kind: T.DataType, path: str):
        self.value, self.kind = payload, kind
        for p in path.split("."):
            if not isinstance(self.kind, T.StructType) or p not in self.kind.names:
                self.value, self.kind = None, None
                return
            self.value, self.kind = self.value.getField(p), self.kind[p].dataType

    def exists(self) -> Column:
        return F.lit(False) if self.value is None else self.value.isNotNull()

    def _fits(self, x: Any) -> bool:
        if self.kind is None or x is None:
            return False
        if isinstance(x, bool):
            return isinstance(self.kind, T.BooleanType)
        if isinstance(x, (int, float)):
            return isinstance(self.kind, T.NumericType)
        return isinstance(x, str) and isinstance(self.kind, T.StringType)

    def equal(self, x: Any) -> Column:
        return self.value == F.lit(x) if self._fits(x) else F.lit(False)

    def ordered(self, op: str, x: Any) -> Column:
        return _compare(op, self.value, x) if self._fits(x) and not isinstance(x, bool) else F.lit(False)


def _compare(op: str, a: Column, x: Any) -> Column:
    return {"$gt": a > x, "$gte": a >= x, "$lt": a < x, "$lte": a <= x}[op]


def compile_filter(spec: dict, payload: Column, kind: T.DataType | None = None, strict_json: bool = False) -> Column:
    """The filter as a boolean Column that is never null.

    kind: the payload's type; a struct is read by its fields (so predicates reach the scan), a string is parsed as
    JSON. strict_json tells integers from other numbers under $eq, $ne and $in.
    """
    validate(spec)
    if isinstance(kind, T.StructType):
        field = lambda path: _Typed(payload, kind, path)
    else:
        parsed = F.try_parse_json(payload) if kind is None or isinstance(kind, T.StringType) else payload
        field = lambda path: _Variant(parsed, path, strict_json)

    def build(x: dict) -> Column:
        if "$and" in x:
            return reduce(lambda a, b: a & b, map(build, x["$and"]), F.lit(True))
        if "$or" in x:
            return reduce(lambda a, b: a | b, map(build, x["$or"]), F.lit(False))
        ((path, test),) = x.items()
        ((op, value),) = test.items()
        f = field(path)
        if op == "$eq":
            out = f.equal(value)
        elif op == "$ne":
            out = f.exists() & ~F.coalesce(f.equal(value), F.lit(False))
        elif op == "$in":
            out = reduce(lambda a, b: a | b, [F.coalesce(f.equal(v), F.lit(False)) for v in value], F.lit(False))
        else:
            out = f.ordered(op, value)
        return F.coalesce(out, F.lit(False))

    return build(spec)
