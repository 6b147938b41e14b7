"""JSON Schema checks and tables out of XML."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The JSON Schema types and keywords that are understood.
TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")
KEYWORDS = (
    "type", "required", "properties", "items", "enum", "const", "minimum", "maximum",
    "minLength", "maxLength", "pattern", "additionalProperties",
)


def _described(v: Column, members: Column, elements: Column) -> Column:
    """Schema of a variant that is neither object nor array: the schema of those takes a walk through all they hold."""
    return F.when(members.isNull() & elements.isNull(), F.schema_of_variant(v))


def _kind(v: Column, members: Column, elements: Column, described: Column) -> Column:
    """JSON type of a variant; a whole number is an integer however it is written."""
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(members.isNotNull(), "object")
        .when(elements.isNotNull(), "array")
        .when(described == "STRING", "string")
        .when(described == "BOOLEAN", "boolean")
        .when(described == "VOID", "null")
        .when(number == F.floor(number), "integer")
        .otherwise("number")
    )


def _text(value: object) -> Column:
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


class _Node:
    """A place in the instance: its value, type, members and elements as columns."""

    def __init__(self, value: Column, kind: Column, members: Column, elements: Column) -> None:
        self.value, self.kind, self.members, self.elements = value, kind, members, elements

    def has(self, name: str) -> Column:
        return F.coalesce(F.map_contains_key(self.members, F.lit(name)), F.lit(False))


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _element_rules(value: Column, schema: dict, path: str) -> list:
    """The rules of a value inside an array, as one entry of ``_rules``.

    The value is taken apart once: a transform of an array of one element gives its type and
    members names that all its rules share.
    """
    names: list[tuple[str, str]] = []

    def broken(e: Column) -> Column:
        inner = _rules(_Node(e["v"], e["k"], e["m"], e["a"]), schema, path, _element_rules)
        names.extend(_names(inner))
        return _found(inner)

    def kept(e: Column) -> list[Column]:
        return [e[name].alias(name) for name in ("v", "m", "a")]

    parts = F.transform(F.array(value), lambda v: F.struct(v.alias("v"), _members(v).alias("m"), _elements(v).alias("a")))
    parts = F.transform(parts, lambda e: F.struct(*kept(e), _described(e["v"], e["m"], e["a"]).alias("d")))
    parts = F.transform(parts, lambda e: F.struct(*kept(e), _kind(e["v"], e["m"], e["a"], e["d"]).alias("k")))
    found = F.transform(parts, broken)[0]
    return [(tuple(names), path, found)] if names else []


class _Stages:
    """Columns to add step by step, so that a value is taken apart once and not per rule."""

    def __init__(self) -> None:
        self.steps: list[list[Column]] = []
        self.count = 0

    def node(self, given: Column) -> _Node:
        n = self.count
        self.count += 1
        value, kind, members, elements, described = (F.col(f"__{c}{n}") for c in "vkmad")
        self.steps.append([given.alias(f"__v{n}")])
        self.steps.append([_members(value).alias(f"__m{n}"), _elements(value).alias(f"__a{n}")])
        self.steps.append([_described(value, members, elements).alias(f"__d{n}")])
        self.steps.append([_kind(value, members, elements, described).alias(f"__k{n}")])
        return _Node(value, kind, members, elements)

    def rules(self, value: Column, schema: dict, path: str) -> list:
        return _rules(self.node(value), schema, path, self.rules)

    def added(self) -> list[str]:
        return [f"__{c}{n}" for n in range(self.count) for c in "vkmad"]


def _rules(node: _Node, schema: dict, path: str, child) -> list[tuple[str, str, Column]]:
    """(rule, path, broken) for every keyword of a schema; ``child`` gives those of a member.

    For the rules of an array's elements there is one entry with several (rule, path) names
    and the array of those broken, so each rule is looked at once however deep it lies.
    """
    if schema is True or schema == {}:
        return []
    if not isinstance(schema, dict):
        raise ValueError(f"schema at {path} must be an object, got {schema!r}")
    unknown = set(schema) - set(KEYWORDS)
    if unknown:
        raise ValueError(f"schema keywords not supported at {path}: {sorted(unknown)}")
    v, kind = node.value, node.kind
    is_number, is_text, is_object = kind.isin("integer", "number"), kind == "string", kind == "object"
    out: list[tuple[str, str, Column]] = []
    if "type" in schema:
        allowed = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        if set(allowed) - set(TYPES):
            raise ValueError(f"unknown type at {path}: {allowed}")
        names = allowed + (["integer"] if "number" in allowed else [])
        out.append(("type", path, ~kind.isin(*names)))
    if "enum" in schema:
        out.append(("enum", path, ~F.to_json(v).isin(*[_text(x) for x in schema["enum"]])))
    if "const" in schema:
        out.append(("const", path, F.to_json(v) != _text(schema["const"])))
    number = F.try_variant_get(v, "$", "double")
    if "minimum" in schema:
        out.append(("minimum", path, is_number & (number < F.lit(float(schema["minimum"])))))
    if "maximum" in schema:
        out.append(("maximum", path, is_number & (number > F.lit(float(schema["maximum"])))))
    text = F.try_variant_get(v, "$", "string")
    if "minLength" in schema:
        out.append(("minLength", path, is_text & (F.length(text) < schema["minLength"])))
    if "maxLength" in schema:
        out.append(("maxLength", path, is_text & (F.length(text) > schema["maxLength"])))
    if "pattern" in schema:
        out.append(("pattern", path, is_text & ~text.rlike(schema["pattern"])))
    for name in schema.get("required", ()):
        out.append(("required", f"{path}.{name}", is_object & ~node.has(name)))
    properties = schema.get("properties", {})
    for name, inner in properties.items():
        for rule, where, broken in child(F.element_at(node.members, F.lit(name)), inner, f"{path}.{name}"):
            held = is_object & node.has(name)
            out.append((rule, where, held & broken if isinstance(rule, str) else F.when(held, broken)))
    if "additionalProperties" in schema:
        if schema["additionalProperties"] is False:
            known = F.array(*[F.lit(n) for n in properties]).cast("array<string>")
            extra = F.size(F.array_except(F.map_keys(node.members), known)) > 0
            out.append(("additionalProperties", path, is_object & extra))
        elif schema["additionalProperties"] is not True:
            raise ValueError(f"additionalProperties at {path} must be true or false")
    if "items" in schema:
        names: list[tuple[str, str]] = []

        def of_element(x: Column) -> Column:
            inner = _element_rules(x, schema["items"], f"{path}[]")
            names.extend(_names(inner))
            return _found(inner)

        elements = F.transform(node.elements, of_element)
        if names:
            known = F.array(*[_violation(rule, where) for rule, where in names])
            broken = F.transform(F.array(F.flatten(elements)), lambda held: F.filter(known, lambda name: F.array_contains(held, name)))[0]
            out.append((tuple(names), path, F.when(kind == "array", broken)))
    return out


def _violation(rule: str, path: str) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(path).alias("path"))


def _names(rules: list) -> list[tuple[str, str]]:
    """The (rule, path) names of rules, in their order."""
    return [name for rule, path, _ in rules for name in ([(rule, path)] if isinstance(rule, str) else rule)]


def _found(rules: list) -> Column:
    """The broken ones of rules as an array of (rule, path)."""
    none = F.array().cast("array<struct<rule:string,path:string>>")
    parts = [
        F.array_compact(F.array(F.when(broken, _violation(rule, path)))) if isinstance(rule, str) else F.coalesce(broken, none)
        for rule, path, broken in rules
    ]
    return F.concat(none, *parts)


def json_schema_check(df: DataFrame, col: str, schema: dict) -> DataFrame:
    """``df`` with ``violations`` (array of rule and path) and ``valid``.

    The schema becomes column predicates, so the check runs in the scan. Text that
    is no JSON breaks the rule 'json'; NULL is neither valid nor invalid.
    """
    stages = _Stages()
    root = stages.node(F.try_parse_json(F.col(col)))
    present = root.value.isNotNull()
    rules = [("json", "$", root.value.isNull() & F.col(col).isNotNull())] + [
        (rule, path, present & F.coalesce(broken, F.lit(False)) if isinstance(rule, str) else F.when(present, broken))
        for rule, path, broken in _rules(root, schema, "$", stages.rules)
    ]
    out = df
    for step in stages.steps:
        out = out.select("*", *step)
    out = out.select(*df.columns, _found(rules).alias("__found"))
    # inline keeps a later filter on the result from repeating the check inside it
    valid = F.when(F.col(col).isNotNull(), F.size("__found") == 0)
    return out.select(
        *df.columns,
        F.inline(F.array(F.struct(F.col("__found").alias("violations"), valid.alias("valid")))),
    )


def violation_summary(checked: DataFrame) -> DataFrame:
    """(rule, path, n_rows) over a checked table."""
    return (
        checked.select(F.inline("violations"))
        .groupBy("rule", "path")
        .agg(F.count("*").alias("n_rows"))
    )


def xml_table(df: DataFrame, col: str, row_path: str, columns: dict[str, str]) -> DataFrame:
    """One row per element at ``row_path`` with the given child elements or @attributes.

    ``row_path`` is /root/.../row; ``columns`` maps a child name, or @ and an
    attribute name, to a type. The other columns of ``df`` come along. A document that is
    not well-formed is an error; a NULL one has no rows.
    """
    steps = [s for s in row_path.split("/") if s]
    if len(steps) < 2:
        raise ValueError("row_path needs the root and the row element")
    fields = ", ".join(f"`{'_' + name[1:] if name.startswith('@') else name}` {kind}" for name, kind in columns.items())
    schema = f"`{steps[-1]}` array<struct<{fields.replace('` ', '`: ')}>>"
    for step in reversed(steps[1:-1]):
        schema = f"`{step}` struct<{schema.replace('` ', '`: ', 1)}>"
    record = F.from_xml(F.col(col), schema, {"attributePrefix": "_", "mode": "FAILFAST"})
    others = [c for c in df.columns if c != col]
    rows = df.select(*others, record.alias("__x"))
    at = F.col("__x")
    for step in steps[1:]:
        at = at[step]
    exploded = rows.select(*others, F.explode(at).alias("__row"))
    return exploded.select(
        *others,
        *[F.col("__row")[f"_{n[1:]}" if n.startswith("@") else n].alias(n.lstrip("@")) for n in columns],
    )


def xpath(text: Column, path: str) -> Column:
    """All values at an XPath, as an array of strings."""
    return F.xpath(text, F.lit(path))
