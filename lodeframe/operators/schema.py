"""A schema gate for JSON texts: the keywords of JSON Schema, evaluated over VARIANT values.

A text is parsed once into a VARIANT. Each keyword of a schema becomes a column expression on the value it concerns, so a gate of any schema is one
expression: an array of (path, keyword), one element for each fault, as a validator that reports every error would give. A keyword says nothing
about a value of another type than its own, as the type has its own keyword.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeframe.functions.arrays import let

FAULTS = "array<struct<path:string,keyword:string>>"

# ---- fixed values: the published shapes of an answer, a reason and a citation ------------------------------------------------
_NAME = {"type": "string", "minLength": 1}
_OFFSET = {"type": "integer", "minimum": 0}
_NUMBER = {"type": "number"}
CITATION = {"type": "object", "required": ["doc_id", "span_start", "span_end"], "properties": {"doc_id": _NAME, "span_start": _OFFSET, "span_end": _OFFSET}}
CLAIM = CITATION | {"properties": CITATION["properties"] | {"claim": _NAME, "text": _NAME}, "anyOf": [{"required": ["claim"]}, {"required": ["text"]}]}
REASON = {
    "type": "object",
    "required": ["reason_id", "premise", "mechanism", "answer_implication"],
    "properties": {"reason_id": _NAME, "premise": _NAME, "mechanism": _NAME, "answer_implication": _NAME, "scope": {"type": "object", "properties": {"entities": {"type": "array", "items": _NAME}}}, "citations": {"type": "array", "items": CITATION}},
}


def answer_schema(level: float | None = None) -> dict:
    """The shape of an answer, whose intervals have the level if there is one; keys that it doesn't name are allowed."""
    interval = {"type": "object", "required": ["level", "lo", "hi"], "properties": {"level": _NUMBER if level is None else {"type": "number", "const": level}, "lo": _NUMBER, "hi": _NUMBER}}
    row = {
        "type": "object",
        "required": ["entity_id", "interval", "claims"],
        "properties": {"entity_id": _NAME, "label": {"type": "string"}, "point_forecast": _NUMBER, "rank": {"type": "integer", "minimum": 1}, "interval": interval, "claims": {"type": "array", "minItems": 1, "items": CLAIM}},
    }
    return {
        "type": "object",
        "required": ["task_id", "entity_predictions"],
        "properties": {
            "task_id": _NAME, "schema_version": {"type": "string"}, "target_type": {"enum": ["classification", "regression", "ranking"]}, "evidence_trace": {"type": "string"},
            "entity_predictions": {"type": "array", "minItems": 1, "items": row}, "submitted_reasons": {"type": "array", "minItems": 1, "maxItems": 3, "items": REASON},
        },
    }
# ------------------------------------------------------------------------------------------------------------------------------


_TYPES = {"string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "object": "^OBJECT", "array": "^ARRAY", "number": "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)", "integer": "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"}


def _none() -> Column:
    return F.expr(f"cast(array() as {FAULTS})")


def _fault(when: Column, path: Column, keyword: str) -> Column:
    return F.when(when, F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword")))).otherwise(_none())


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _is(value: Column, kind: str) -> Column:
    of_type = F.schema_of_variant(value).rlike(_TYPES[kind])
    return of_type & (_number(value) == F.floor(_number(value))) if kind == "integer" else of_type


def _equals(value: Column, other: str | float | bool | None) -> Column:
    kind = {str: "string", bool: "boolean", type(None): "null"}.get(type(other), "number")
    if other is None:
        return _is(value, kind)
    return _is(value, kind) & F.coalesce(F.try_variant_get(value, "$", {"string": "string", "boolean": "boolean", "number": "double"}[kind]) == F.lit(other), F.lit(False))


def _on(kind: str, value: Column, read: str, fails) -> Column:
    """Whether a value of a type, read as it, fails; no other value does."""
    return _is(value, kind) & F.coalesce(fails(F.try_variant_get(value, "$", read)), F.lit(False))


#: keywords of one value: what it is to fail one
_SCALAR = {
    "type": lambda v, x: ~_is(v, x),
    "const": lambda v, x: ~_equals(v, x),
    "enum": lambda v, xs: ~F.greatest(*[_equals(v, x) for x in xs], F.lit(False)),
    "minimum": lambda v, x: _on("number", v, "double", lambda n: n < x),
    "maximum": lambda v, x: _on("number", v, "double", lambda n: n > x),
    "exclusiveMinimum": lambda v, x: _on("number", v, "double", lambda n: n <= x),
    "exclusiveMaximum": lambda v, x: _on("number", v, "double", lambda n: n >= x),
    "minLength": lambda v, x: _on("string", v, "string", lambda s: F.length(s) < x),
    "maxLength": lambda v, x: _on("string", v, "string", lambda s: F.length(s) > x),
    "pattern": lambda v, x: _on("string", v, "string", lambda s: ~s.rlike(x)),
    "minItems": lambda v, x: _on("array", v, "array<variant>", lambda a: F.size(a) < x),
    "maxItems": lambda v, x: _on("array", v, "array<variant>", lambda a: F.size(a) > x),
    "anyOf": lambda v, schemas: F.least(*[F.size(_checked(v, F.lit(""), s)) > 0 for s in schemas], F.lit(True)),
}
_MEMBERS = {"required", "properties", "additionalProperties"}


def _members(value: Column, path: Column, schema: dict) -> Column:
    """The faults of an object's keys and of the values under them."""
    properties = schema.get("properties", {})

    def of(held: Column) -> Column:
        has = lambda key: F.map_contains_key(held, F.lit(key))
        found = [_fault(~has(key), path, "required") for key in schema.get("required", [])]
        if schema.get("additionalProperties", True) is False:
            found.append(_fault(F.size(F.array_except(F.map_keys(held), F.array(*map(F.lit, properties)).cast("array<string>"))) > 0, path, "additionalProperties"))
        found += [F.when(has(key), _checked(F.try_element_at(held, F.lit(key)), F.concat(path, F.lit(f"/{key}")), sub)).otherwise(_none()) for key, sub in properties.items()]
        return F.concat(_none(), *found)

    return F.when(_is(value, "object"), let(F.try_variant_get(value, "$", "map<string,variant>"), of)).otherwise(_none())


def _checked(value: Column, path: Column, schema: dict) -> Column:
    found = [_fault(_SCALAR[key](value, wanted), path, key) for key, wanted in schema.items() if key in _SCALAR]
    if _MEMBERS & set(schema):
        found.append(_members(value, path, schema))
    if "items" in schema:
        each = lambda x, i: _checked(x, F.concat(path, F.lit("/"), i.cast("string")), schema["items"])
        found.append(F.when(_is(value, "array"), F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), each))).otherwise(_none()))
    unknown = set(schema) - set(_SCALAR) - _MEMBERS - {"items"}
    if unknown:
        raise ValueError(f"no such keyword: {sorted(unknown)}")
    return F.concat(_none(), *found)


def schema_faults(text: Column, schema: dict) -> Column:
    """Every fault of a JSON text as (path, keyword): path as in /entity_predictions/0/claims/1, the keyword that fails there.

    A text that is no JSON, or null, has the one fault json; one key twice in an object is no JSON.
    """
    return let(F.try_parse_json(text), lambda v: F.when(v.isNull(), _fault(F.lit(True), F.lit(""), "json")).otherwise(_checked(v, F.lit(""), schema)))
