"""JSON Schema (draft 07) as columns: every rule of a schema becomes an expression over the typed column, map or variant it speaks of.

A keyword counts only for values of the kind it is about, as the draft has it: a minimum says nothing of a text. Null is an absent value: only `required` sees it.
Kinds of typed columns are known when the plan is made, so that rules that can't apply leave nothing behind; of variants they are read from the value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_, or_
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.functions import scalar as S
from doclathe.sources.errors import ConfigError

NONE = "array<struct<path:string,keyword:string>>"
STRICT = {"email": S.EMAIL, "url": S.URL, "uuid": S.UUID, "ipv4": S.IPV4}


def joined(parts: list[Column]) -> Column:
    empty = F.array().cast(NONE)
    return F.flatten(F.array(*[F.coalesce(x, empty) for x in parts])) if parts else empty


def kind(typ: T.DataType) -> str:
    for name, types in (("boolean", T.BooleanType), ("integer", T.IntegralType), ("number", T.NumericType), ("array", T.ArrayType), ("object", (T.StructType, T.MapType))):
        if isinstance(typ, types):
            return name
    return "string"


def assumed(p: Any) -> T.DataType:
    """The column type a schema speaks of, where no type is known."""
    t = p.get("type", "string") if isinstance(p, dict) else "string"
    t = next((x for x in t if x != "null"), "string") if isinstance(t, list) else t
    if t == "array":
        return T.ArrayType(assumed(p.get("items", {})))
    if t == "object":
        return T.StructType([T.StructField(k, assumed(v)) for k, v in p.get("properties", {}).items()])
    return {"boolean": T.BooleanType(), "integer": T.LongType(), "number": T.DoubleType()}.get(t, T.StringType())


def value_schema(v: dict[str, Any]) -> dict[str, Any]:
    """The JSON Schema of a dynamic object's values, from any of its layouts."""
    if "schemas" not in v:
        return v
    if len(v["schemas"]) == 1:
        return v["schemas"][0]
    return {"anyOf": v["schemas"], "x-type-probabilities": v.get("typeProbabilities")} if v["schemas"] else {"type": "string"}


def kind_of(value: Any) -> str:
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def variant_kind(col: Column) -> Column:
    raw = F.regexp_extract(F.schema_of_variant(col), r"^[A-Z]+", 0)
    return F.when(raw.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number").when(raw == "VOID", "null").when(raw.isin("STRING", "BOOLEAN", "ARRAY", "OBJECT"), F.lower(raw)).otherwise("other")


def member(col: Column, name: str) -> Column:
    """A member of a variant object, null if it has none. Every key is written as a quoted string of the path."""
    return F.try_variant_get(col, "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant") if "'" not in name else F.try_element_at(F.try_variant_get(col, "$", "map<string,variant>"), F.lit(name))


def equal(col: Column, typ: T.DataType, value: Any) -> Column:
    """Whether a value is the literal, as JSON has it: numbers by value, objects whatever the order of their keys, arrays in order. A null column is an absent value, and equal to null only."""
    k = kind_of(value)
    if isinstance(typ, T.VariantType):
        if k == "null":
            return col.isNull() | (variant_kind(col) == "null")
        is_k = F.coalesce(variant_kind(col) == k, F.lit(False))
        if k in ("number", "string", "boolean"):
            return is_k & (F.try_variant_get(col, "$", "double" if k == "number" else k) == F.lit(float(value) if k == "number" else value))
        if k == "array":
            parts = [F.size(F.try_variant_get(col, "$", "array<variant>")) == len(value)] + [equal(F.try_variant_get(col, f"$[{i}]", "variant"), typ, v) for i, v in enumerate(value)]
        else:
            parts = [F.size(F.try_variant_get(col, "$", "map<string,variant>")) == len(value)] + [member(col, n).isNotNull() & equal(member(col, n), typ, v) for n, v in value.items()]
        return is_k & F.coalesce(reduce(and_, parts), F.lit(False))
    own = kind(typ)
    if k == "null":
        return col.isNull()
    if ("number" if own == "integer" else own) != k:
        return F.lit(False)
    if k == "array":
        parts = [F.size(col) == len(value)] + [equal(F.get(col, F.lit(i)), typ.elementType, v) for i, v in enumerate(value)]
    elif k == "object" and isinstance(typ, T.MapType):
        parts = [F.size(col) == len(value)] + [F.map_contains_key(col, F.lit(n)) & equal(F.try_element_at(col, F.lit(n)), typ.valueType, v) for n, v in value.items()]
    elif k == "object":  # an absent member and one that is null are the same in a struct
        inner = {f.name: f.dataType for f in typ.fields}
        parts = [equal(col.getField(n), t, value.get(n)) for n, t in inner.items()] + [F.lit(v is None) for n, v in value.items() if n not in inner]
    else:
        parts = [col == F.lit(value)]
    return F.coalesce(col.isNotNull() & reduce(and_, parts, F.lit(True)), F.lit(False))


def one_of(col: Column, typ: T.DataType, allowed: list[Any]) -> Column:
    """Whether a value is one of the literals; those of a kind in one test."""
    tests = []
    for k, as_ in (("number", "double"), ("string", "string"), ("boolean", "boolean")):
        if own := [float(v) if k == "number" and isinstance(typ, T.VariantType) else v for v in allowed if kind_of(v) == k]:
            if isinstance(typ, T.VariantType):
                tests.append((variant_kind(col) == k) & F.try_variant_get(col, "$", as_).isin(own))
            elif (kind(typ) if kind(typ) != "integer" else "number") == k:
                tests.append(col.isin(own))
    tests += [equal(col, typ, v) for v in allowed if kind_of(v) in ("null", "array", "object")]
    return F.coalesce(S.balanced(or_, tests), F.lit(False)) if tests else F.lit(False)


def canonical(col: Column, typ: T.DataType) -> Column:
    """Text that is the same for equal values: keys in the order of variants, numbers without closing zeros."""
    if not isinstance(typ, (T.VariantType, T.StructType, T.MapType, T.ArrayType)):
        return col.cast("double").cast("string") if isinstance(typ, T.NumericType) else col.cast("string")
    text = F.to_json(col) if isinstance(typ, T.VariantType) else F.to_json(F.parse_json(F.to_json(col)))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+(?![0-9])", "$1"), r"\.(?![0-9])", "")
    parts = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|[^"]+'), F.lit(0))
    return F.concat_ws("", F.transform(parts, lambda x: F.when(x.startswith('"'), x).otherwise(plain(x))))


class Rules:
    """Compiles schemas; strict checks all formats, else object ids only.

    `$ref` is followed inside the schema, as a JSON pointer or an `$id`. A reference that meets itself again, in a schema of trees for one, is compiled `depth` times; values nested deeper, which only variants can
    hold, break the rule `$ref`, so none passes unchecked. A reference that leads nowhere is an error."""

    def __init__(self, strict: bool = False, root: Any = None, depth: int = 4):
        self.strict, self.root, self.depth, self.open = strict, root, depth, []

    def target(self, ref: str) -> Any:
        if ref.startswith("#") and not (named := self.named(self.root, ref)):
            at = self.root
            for step in ref[1:].split("/")[1:]:
                step = unquote(step).replace("~1", "/").replace("~0", "~")
                at = at[int(step)] if isinstance(at, list) and step.isdigit() and int(step) < len(at) else at.get(step) if isinstance(at, dict) else None
                if at is None:
                    raise ConfigError(f"the schema has no {ref}")
            return at
        if (named := self.named(self.root, ref)) is None:
            raise ConfigError(f"the schema has no {ref}")
        return named[0]

    def named(self, at: Any, ref: str) -> list[Any] | None:
        """The subschema whose $id is ref, in a list."""
        if isinstance(at, dict):
            return [at] if at.get("$id") == ref else next((x for v in at.values() if (x := self.named(v, ref))), None)
        return next((x for v in at if (x := self.named(v, ref))), None) if isinstance(at, list) else None

    @staticmethod
    def bad(cond: Column, path: str, keyword: str) -> Column:
        return F.when(cond, F.array(F.struct(F.lit(path).alias("path"), F.lit(keyword).alias("keyword"))))

    def of(self, col: Column, typ: T.DataType, p: Any, path: str) -> list[Column]:
        """Violations of p by one value: columns of NONE, null where there is none."""
        if p is True or p == {}:
            return []
        if p is False:
            return [self.bad(col.isNotNull(), path, "false schema")]
        if self.root is None:
            self.root = p
        if "$ref" in p:  # its siblings don't count
            if self.open.count(p["$ref"]) >= self.depth:
                return [self.bad(col.isNotNull(), path, "$ref")]
            self.open.append(p["$ref"])
            try:
                return self.of(col, typ, self.target(p["$ref"]), path)
            finally:
                self.open.pop()
        told = p.get("type")
        told = [told] if isinstance(told, str) else told
        if isinstance(typ, T.VariantType):
            return self.variant(col, p, told, path)
        out, k = [], kind(typ)
        if told is not None and k not in told and not (k == "integer" and "number" in told):
            out.append(self.bad(col != F.floor(col), path, "type") if k == "number" and "integer" in told else self.bad(col.isNotNull(), path, "type"))
        out += self.values(col, typ, p, path) + self.combined(col, typ, p, path) + self.keywords(col, typ, k, p, path)
        if isinstance(typ, T.StructType):
            return out + self.fields(col, typ, p, path)
        if isinstance(typ, T.MapType):
            return out + self.members(col.isNotNull(), col, typ.valueType, lambda n: F.try_element_at(col, F.lit(n)), p, path)
        return out

    def variant(self, col: Column, p: dict[str, Any], told: list[str] | None, path: str) -> list[Column]:
        raw = F.regexp_extract(F.schema_of_variant(col), r"^[A-Z]+", 0)
        num = F.try_variant_get(col, "$", "double")
        is_ = {"number": raw.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "string": raw == "STRING", "boolean": raw == "BOOLEAN", "array": raw == "ARRAY", "object": raw == "OBJECT", "null": raw == "VOID"}
        is_["integer"] = is_["number"] & (num == F.floor(num))
        out = [] if told is None else [self.bad(col.isNotNull() & ~reduce(or_, [is_[t] for t in told]), path, "type")]
        as_ = lambda k: F.when(is_[k], F.try_variant_get(col, "$", {"number": "double", "array": "array<variant>", "object": "map<string,variant>"}.get(k, k)))
        out += self.values(col, T.VariantType(), p, path)
        out += self.combined(col, T.VariantType(), p, path)
        for k, typ in (("number", T.DoubleType()), ("string", T.StringType()), ("array", T.ArrayType(T.VariantType()))):
            out += self.keywords(as_(k), typ, k, p, path)
        # Members are read by name; the whole object is made a map only for rules about all of them.
        value = lambda n: member(col, n)
        return out + self.members(is_["object"], as_("object"), T.VariantType(), value, p, path)

    def ok(self, col: Column, typ: T.DataType, p: Any, path: str) -> Column:
        return F.size(joined(self.of(col, typ, p, path))) == 0

    def keywords(self, col: Column, typ: T.DataType, k: str, p: dict[str, Any], path: str) -> list[Column]:
        """Rules about one kind only."""
        out, tests = [], {}
        if k in ("integer", "number"):
            tests = {"minimum": lambda x: col < x, "maximum": lambda x: col > x, "exclusiveMinimum": lambda x: col <= x, "exclusiveMaximum": lambda x: col >= x, "multipleOf": lambda x: F.abs(col / x - F.round(col / x)) > 1e-9}
        elif k == "string":
            tests = {"minLength": lambda x: F.length(col) < x, "maxLength": lambda x: F.length(col) > x, "pattern": lambda x: ~col.rlike(x)}
            fmt = S.OBJECTID if p.get("format") == "objectid" else STRICT.get(p.get("format")) if self.strict else None
            if fmt:
                out.append(self.bad(~col.rlike(fmt), path, "format"))
        elif k == "array":
            plain = F.transform(col, lambda x: canonical(x, typ.elementType))
            tests = {"minItems": lambda x: F.size(col) < x, "maxItems": lambda x: F.size(col) > x, "uniqueItems": lambda x: F.lit(bool(x)) & (F.size(F.array_distinct(plain)) < F.size(col))}
            out += self.items(col, typ.elementType, p, path)
        return out + [self.bad(test(p[name]), path, name) for name, test in tests.items() if name in p]

    def values(self, col: Column, typ: T.DataType, p: dict[str, Any], path: str) -> list[Column]:
        """enum and const."""
        told = (("enum", p.get("enum")), ("const", [p["const"]] if "const" in p else None))
        return [self.bad(col.isNotNull() & ~one_of(col, typ, allowed), path, name) for name, allowed in told if allowed is not None]

    def combined(self, col: Column, typ: T.DataType, p: dict[str, Any], path: str) -> list[Column]:
        """allOf, anyOf, oneOf, not, if: about any kind."""
        out = []
        for x in p.get("allOf", []):
            out += self.of(col, typ, x, path)
        for name, fine in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
            if name in p:
                n = reduce(add, [self.ok(col, typ, x, path).cast("int") for x in p[name]], F.lit(0))
                out.append(self.bad(col.isNotNull() & ~fine(n), path, name))
        if "not" in p:
            out.append(self.bad(col.isNotNull() & self.ok(col, typ, p["not"], path), path, "not"))
        if "if" in p:
            yes = self.ok(col, typ, p["if"], path)
            out += [F.when(yes, joined(self.of(col, typ, p.get("then", True), path))), F.when(~yes, joined(self.of(col, typ, p.get("else", True), path)))]
        return out

    def items(self, col: Column, element: T.DataType, p: dict[str, Any], path: str) -> list[Column]:
        each, at = p.get("items", True), path + "[]"
        out = []
        if isinstance(each, list):
            for i, x in enumerate(each):
                out += self.of(F.get(col, F.lit(i)), element, x, at)
            col, each = F.slice(col, len(each) + 1, F.greatest(F.size(col), F.lit(1))), p.get("additionalItems", True)
        if each is False:
            return [*out, self.bad(F.size(col) > 0, path, "additionalItems")]
        if each is not True and self.of(F.lit(None), element, each, at):
            out.append(F.flatten(F.transform(col, lambda x: joined(self.of(x, element, each, at)))))
        if "contains" in p:
            out.append(self.bad(~F.exists(col, lambda x: self.ok(x, element, p["contains"], at)), path, "contains"))
        return out

    def entries(self, col: Column, inner: T.DataType, mine: Callable[[Column], Column], p: Any, path: str) -> Column:
        """Violations of p by the values of a map whose keys are `mine`."""
        return F.flatten(F.transform(F.map_values(F.map_filter(col, lambda k, _: mine(k))), lambda x: joined(self.of(x, inner, p, path))))

    def fields(self, col: Column, typ: T.StructType, p: dict[str, Any], path: str) -> list[Column]:
        """Rules about the members of a struct."""
        props, patterns, extra = p.get("properties", {}), p.get("patternProperties", {}), p.get("additionalProperties", True)
        types, out = {f.name: f.dataType for f in typ.fields}, []
        for n, of in types.items():
            rules = [props[n]] if n in props else []
            rules += [v for rx, v in patterns.items() if S.found(rx, n)]
            for r in rules or ([] if extra is False else [extra]):
                out += self.of(col.getField(n), of, r, f"{path}/{n}")
            if not rules and extra is False:
                out.append(self.bad(col.getField(n).isNotNull(), f"{path}/{n}", "additionalProperties"))
        size = S.balanced(add, [F.lit(0), *[col.getField(n).isNotNull().cast("int") for n in types]])
        if isinstance(p.get("propertyNames"), (dict, bool)):
            wrong = [col.getField(n).isNotNull() & ~self.ok(F.lit(n), T.StringType(), p["propertyNames"], path) for n in types]
            out.append(self.bad(S.balanced(or_, [F.lit(False), *wrong]), path, "propertyNames"))
        out += self.dependent(col.isNotNull(), col, typ, lambda n: col.getField(n) if n in types else F.lit(None), p, path)
        return out + self.counted(col.isNotNull(), size, lambda n: col.getField(n) if n in types else F.lit(None), p, path)

    def members(self, there: Column, col: Column, inner: T.DataType, value: Callable[[str], Column], p: dict[str, Any], path: str) -> list[Column]:
        """Rules about the members of a map, which `col` is where `there` holds."""
        props, patterns, extra, out = p.get("properties", {}), p.get("patternProperties", {}), p.get("additionalProperties", True), []
        for n, v in props.items():
            out += self.of(value(n), inner, v, f"{path}/{n}")
        known = lambda k: reduce(or_, [k.rlike(rx) for rx in patterns], k.isin(list(props)) if props else F.lit(False))
        for rx, v in patterns.items():
            out.append(self.entries(col, inner, self.like(rx), v, path + "/*"))
        dynamic = p.get("x-dynamic-keys")
        others = value_schema(v) if dynamic is not None and (v := dynamic.get("valueSchema") or p.get("x-dynamic-key-value-schema")) else extra
        if isinstance(others, dict) and others:
            out.append(self.entries(col, inner, lambda k: ~known(k), others, path + "/*"))
        elif others is False and dynamic is None:
            out.append(F.transform(F.filter(F.map_keys(col), lambda k: ~known(k)), lambda k: F.struct(F.concat(F.lit(path + "/"), k).alias("path"), F.lit("additionalProperties").alias("keyword"))))
        if isinstance(p.get("propertyNames"), (dict, bool)):
            out.append(self.bad(F.exists(F.map_keys(col), lambda k: ~self.ok(k, T.StringType(), p["propertyNames"], path)), path, "propertyNames"))
        out += self.dependent(there, col, T.MapType(T.StringType(), inner), value, p, path)
        return out + self.counted(there, F.size(col), value, p, path)

    def dependent(self, there: Column, col: Column, typ: T.DataType, value: Callable[[str], Column], p: dict[str, Any], path: str) -> list[Column]:
        """What the presence of a member asks for: other members, or a schema of the whole object."""
        out = []
        for name, need in p.get("dependencies", {}).items():
            has = there & value(name).isNotNull()
            if isinstance(need, list):
                if need:
                    out.append(self.bad(has & reduce(or_, [value(n).isNull() for n in need]), path, "dependencies"))
            else:
                out.append(F.when(has, joined(self.of(col, typ, need, path))))
        return out

    @staticmethod
    def like(rx: str) -> Callable[[Column], Column]:
        return lambda k: k.rlike(rx)

    def counted(self, there: Column, size: Column, value: Callable[[str], Column], p: dict[str, Any], path: str) -> list[Column]:
        out = [self.bad(there & value(n).isNull(), f"{path}/{n}", "required") for n in p.get("required", [])]
        return out + [self.bad(there & test, path, name) for name, test in (("minProperties", size < p.get("minProperties", 0)), ("maxProperties", size > p.get("maxProperties", 0))) if name in p]
