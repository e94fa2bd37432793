"""A JSON Schema known when the plan is made, compiled to one column expression: no Python runs on rows.

The text is first rewritten so that every scalar is a string that says what it is (a mark
and the spelling); objects are then read as ordered maps and lists as arrays, a level at a
time, and every keyword of the schema becomes an expression over the value at its place.
Messages and their order are those of jsonschema.Validator, which stays the plain version.
What can't be compiled (a schema that contains itself, a pattern that Java reads
otherwise) raises Uncompiled when the plan is made; callers then use the plain version.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, functions as F

from . import jsontext as jt

STRING, NUMBER, WORD = "\x04", "\x03", "\x05"
_MAP, _LIST = "map<string,string>", "array<string>"
_EMPTY = "array<string>"
#: What Python calls the kinds of JSON values (fixed values).
KINDS = {"string": "str", "boolean": "bool", "object": "dict", "array": "list", "null": "NoneType"}
#: Patterns with any of these may mean something else in Java.
_FOREIGN = ("(?", "&&", "[[", "\\Z", "\\A", "\\N", "\\u", "\\x", "\\p", "\\Q", "\\h", "\\v", "\\R", "\\G", "\\z", "\\X", "\\e", "\\c", "++", "*+", "?+", "}+")


class Uncompiled(ValueError):
    """The schema has no column expression."""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def none() -> Column:
    return F.array().cast(_EMPTY)


def marked(text: Column) -> Column:
    """The root value: an object's or a list's text, or a marked scalar."""
    escape = lambda mark: f"\\u{ord(mark):04x}"
    literal = lambda t: F.concat(F.lit('"'), F.when(t.rlike("^[-0-9]"), escape(NUMBER)).otherwise(escape(WORD)), t, F.lit('"'))
    string = lambda s: F.concat(F.lit(f'"{escape(STRING)}'), s, F.lit('"'))
    put = lambda part, token, mark: jt.quoted_tokens(part, token, f'"{chr(92) * 2}{escape(mark)[1:]}$1"')
    # words before numbers: then what a word has become doesn't begin like a number
    quick = lambda part: put(put(part, r"[^-0-9\[\]{},:\s][^\[\]{},:\s]*", WORD), r"[-0-9][^\[\]{},:\s]*", NUMBER)
    return F.get(F.from_json(F.concat(F.lit("["), jt.rewritten(text, literal, string, quick=quick), F.lit("]")), _LIST), F.lit(0))


def is_object(x: Column) -> Column:
    return x.startswith("{")


def is_list(x: Column) -> Column:
    return x.startswith("[")


def is_string(x: Column) -> Column:
    return x.startswith(STRING)


def is_number(x: Column) -> Column:
    return x.startswith(NUMBER)


def content(x: Column) -> Column:
    """A scalar without its mark."""
    return F.substring(x, F.lit(2), F.length(x))


def members(x: Column) -> Column:
    """Names (marked, in their order) and values of an object."""
    return F.from_json(x, _MAP)


def type_name(x: Column) -> Column:
    word = F.when(content(x) == "null", KINDS["null"]).otherwise(KINDS["boolean"])
    number = F.when(jt.whole(content(x)), "int").otherwise("float")
    return F.when(is_object(x), KINDS["object"]).when(is_list(x), KINDS["array"]).when(is_string(x), KINDS["string"]).when(is_number(x), number).otherwise(word)


def _is(kind: str, x: Column) -> Column:
    tests = {
        "string": is_string, "object": is_object, "array": is_list, "number": is_number,
        "integer": lambda v: is_number(v) & jt.whole(content(v)), "null": lambda v: v == f"{WORD}null", "boolean": lambda v: v.isin(f"{WORD}true", f"{WORD}false"),
    }
    return tests[kind](x) if kind in tests else F.lit(True)


def python_text(s: Column) -> Column:
    """A string as Python prints it."""
    odd = r"[\p{C}\p{Z}&&[^ ]]"
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    digits = lambda c, n: F.lower(F.lpad(F.hex(code(c)), n, "0"))
    short = lambda c: F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t")
    long = lambda c: F.when(code(c) < 256, F.concat(F.lit("\\x"), digits(c, 2))).when(code(c) < 65536, F.concat(F.lit("\\u"), digits(c, 4))).otherwise(F.concat(F.lit("\\U"), digits(c, 8)))
    escaped = lambda t: F.when(t.rlike(odd), F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.rlike(odd), F.coalesce(short(c), long(c))).otherwise(c)), "")).otherwise(t)
    body = escaped(F.replace(s, F.lit("\\"), F.lit("\\\\")))
    double = s.contains("'") & ~s.contains('"')
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _decoded(inner: Column) -> Column:
    """The value of a JSON string from what stands between its marks."""
    return F.get(F.from_json(F.concat(F.lit('["'), jt.unmasked(inner), F.lit('"]')), _LIST), F.lit(0))


def _scalar(x: Column, number: Callable[[Column], Column], words: dict[str, str], string: Callable[[Column], Column]) -> Column:
    word = F.when(content(x) == "true", words["true"]).when(content(x) == "false", words["false"]).otherwise(words["null"])
    return F.when(is_string(x), string(content(x))).when(is_number(x), number(content(x))).otherwise(word)


def _inside(x: Column, scalar: Callable[[Column], Column], comma: str, colon: str) -> Column:
    """Text of a list or object with its scalars written anew."""
    return jt.rewritten(x, lambda t: t, lambda s: let(_decoded(s), scalar), comma, colon)


def printed(x: Column) -> Column:
    """A value as Python prints it."""
    scalar = lambda v: _scalar(v, jt.python_number, {"true": "True", "false": "False", "null": "None"}, python_text)
    return F.when(is_object(x) | is_list(x), _inside(x, scalar, ", ", ": ")).otherwise(scalar(x))


def spelled(x: Column) -> Column:
    """One text for all values that are equal."""
    scalar = lambda v: _scalar(v, lambda n: jt.equal_number(n, jt.python_float), {"true": "1", "false": "0", "null": "null"}, jt.json_string)
    deep = F.to_json(F.try_parse_json(_inside(x, lambda v: jt.json_string(scalar(v)), ",", ":")))
    return F.when(is_object(x) | is_list(x), deep).otherwise(scalar(x))


class Compiler:
    """Turns one schema into expressions. ``partly`` asks for no required property."""

    def __init__(self, schema: dict, partly: bool = False) -> None:
        self.root, self.partly, self.defs = schema, partly, schema.get("$defs", {})

    def __call__(self, text: Column) -> Column:
        """Problems of a JSON text, an empty array if none; text that is no JSON, or null, has one."""
        if not self.root:
            return F.when(jt.parsed(text).isNotNull(), none()).otherwise(F.array(F.lit("$: not JSON")))
        found = let(marked(text), lambda x: self.walk(x, self.root, F.lit("$"), ()))
        return F.when(jt.parsed(text).isNotNull(), found).otherwise(F.array(F.lit("$: not JSON")))

    def member(self, text: Column, name: str, sub: dict) -> Column:
        """Problems of one member of an object with a schema of its own; none where it isn't given."""
        return let(F.try_element_at(members(marked(text)), F.lit(STRING + name)), lambda x: self.present(x, sub, F.lit(f"$.{name}"), ()))

    def resolved(self, schema: dict, open_refs: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
        ref = str(schema.get("$ref", ""))
        if not ref.startswith("#/$defs/"):
            return schema, open_refs
        if ref in open_refs:
            raise Uncompiled(f"{ref} contains itself")
        return {**schema, **self.defs.get(ref.rpartition("/")[2], {}), "$ref": ""}, (*open_refs, ref)

    def walk(self, x: Column, schema: dict, path: Column, open_refs: tuple[str, ...]) -> Column:
        """The problems of the value x, in the order of the plain version: keywords that settle all, parts, type, members, limits."""
        schema, open_refs = self.resolved(schema, open_refs)
        say = lambda *texts: F.concat(path, *[t if isinstance(t, Column) else F.lit(t) for t in texts])
        rest = self.branches(x, schema, path, open_refs, say)
        if rest is None:
            parts = [self.walk(x, b, path, open_refs) for b in schema.get("allOf", ())]
            kinds = schema.get("type")
            kinds = [kinds] if isinstance(kinds, str) else kinds or []
            typed = F.concat(none(), *self.inner(x, schema, path, open_refs, say), *self.limits(x, schema, say))
            if kinds:
                fits = F.lit(False)
                for kind in kinds:
                    fits = fits | _is(kind, x)
                typed = F.when(fits, typed).otherwise(F.array(say(f": expected {'/'.join(kinds)}, got ", type_name(x))))
            rest = F.concat(*parts, typed) if parts else typed
        if "enum" in schema:
            known = spelled(x).isin(*[self.constant(v) for v in schema["enum"]]) if schema["enum"] else F.lit(False)
            rest = F.when(known, rest).otherwise(F.array(say(": ", printed(x), f" not in enum {schema['enum']!r}")))
        if "const" in schema:
            rest = F.when(spelled(x) == self.constant(schema["const"]), rest).otherwise(F.array(say(f": expected const {schema['const']!r}")))
        return rest

    @staticmethod
    def constant(value: object) -> str:
        """``spelled`` of a value known now."""

        def plain(v: object) -> object:
            if isinstance(v, bool):
                return "1" if v else "0"
            if isinstance(v, (int, float)):
                return str(int(v)) if isinstance(v, int) or (v == int(v) and abs(v) < 9.2e18) else repr(v)
            return "null" if v is None else json.dumps(v, ensure_ascii=False)

        def deep(v: object) -> object:
            if isinstance(v, dict):
                return {name: deep(v[k]) for name, k in sorted((_name(k), k) for k in v)}
            return [deep(i) for i in v] if isinstance(v, list) else plain(v)

        if not isinstance(value, (dict, list)):
            return plain(value)
        if '"' in str(value) or "\\" in str(value) or any(ord(c) < 32 or ord(c) > 0xFFFF for c in str(value)):
            raise Uncompiled("an escaped constant in a list or object")
        return json.dumps(deep(value), ensure_ascii=False, separators=(",", ":"))

    def branches(self, x: Column, schema: dict, path: Column, open_refs: tuple[str, ...], say: Callable[..., Column]) -> Column | None:
        for key in ("anyOf", "oneOf"):
            if key in schema:
                if not schema[key]:
                    return F.array(say(f": matches no {key} branch ()"))
                tried = F.array(*[self.walk(x, b, path, open_refs) for b in schema[key]])
                firsts = lambda t: F.array_join(F.transform(t, lambda p: F.get(p, F.lit(0))), "; ")
                return let(tried, lambda t: F.when(F.exists(t, lambda p: F.size(p) == 0), none()).otherwise(F.array(say(f": matches no {key} branch (", firsts(t), ")"))))
        return None

    def inner(self, x: Column, schema: dict, path: Column, open_refs: tuple[str, ...], say: Callable[..., Column]) -> list[Column]:
        out = []
        props = schema.get("properties") or {}
        required = [] if self.partly else list(schema.get("required") or ())
        closed = schema.get("additionalProperties") is False
        if props or required or closed:

            def own(m: Column) -> Column:
                missing = [F.when(F.try_element_at(m, F.lit(STRING + name)).isNull(), F.array(say(f": missing required {name!r}"))).otherwise(none()) for name in required]
                walked = [let(F.try_element_at(m, F.lit(STRING + name)), partial(self.present, schema=sub, path=F.concat(path, F.lit(f".{name}")), open_refs=open_refs)) for name, sub in props.items()]
                known = F.array(*[F.lit(STRING + name) for name in props]) if props else none()
                extra = [F.transform(F.filter(F.map_keys(m), lambda k: ~F.array_contains(known, k)), lambda k: say(": unexpected property ", python_text(content(k))))] if closed else []
                return F.concat(none(), *missing, *walked, *extra)

            out.append(F.when(is_object(x), let(members(x), own)).otherwise(none()))
        if isinstance(schema.get("items"), dict):
            item = lambda v, i: self.walk(v, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), open_refs)
            out.append(F.when(is_list(x), F.flatten(F.transform(F.from_json(x, _LIST), item))).otherwise(none()))
        return out

    def present(self, v: Column, schema: dict, path: Column, open_refs: tuple[str, ...]) -> Column:
        return F.when(v.isNotNull(), self.walk(v, schema, path, open_refs)).otherwise(none())

    def limits(self, x: Column, schema: dict, say: Callable[..., Column]) -> list[Column]:
        size, length = F.size(F.from_json(x, _LIST)), F.length(content(x))
        checks = {
            "minItems": (is_list, lambda n: size < n, "fewer than {} items"), "maxItems": (is_list, lambda n: size > n, "more than {} items"),
            "minLength": (is_string, lambda n: length < n, "shorter than minLength {}"), "maxLength": (is_string, lambda n: length > n, "longer than maxLength {}"),
            "pattern": (is_string, lambda p: ~content(x).rlike(java_pattern(p)), "does not match pattern {!r}"),
            "minimum": (is_number, lambda n: compared(x, n) < 0, "below minimum {}"), "maximum": (is_number, lambda n: compared(x, n) > 0, "above maximum {}"),
            "exclusiveMinimum": (is_number, lambda n: compared(x, n) <= 0, "not above exclusiveMinimum {}"), "exclusiveMaximum": (is_number, lambda n: compared(x, n) >= 0, "not below exclusiveMaximum {}"),
        }
        return [F.when(applies(x) & broken(schema[key]), F.array(say(": " + text.format(schema[key])))).otherwise(none()) for key, (applies, broken, text) in checks.items() if key in schema]


def _name(k: str) -> str:
    """A member's name as ``spelled`` writes it."""
    return json.dumps(k, ensure_ascii=False)


def compared(x: Column, limit: float) -> Column:
    """The sign of a number less a limit; whole numbers of up to 37 digits are exact."""
    near = F.signum(content(x).cast("double") - F.lit(float(limit)))
    if not isinstance(limit, int) or abs(limit) >= 10**37:
        return near
    exact = F.signum(content(x).try_cast("decimal(38,0)") - F.lit(limit).cast("decimal(38,0)"))
    return F.when(jt.whole(content(x)) & (F.length(x) < 38), exact).otherwise(near)


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java: classes of characters hold all of Unicode, and only a line feed ends a line."""
    if any(word in pattern for word in _FOREIGN) or re.search(r"\[[^\]]*\[", pattern):
        raise Uncompiled(f"pattern {pattern}")
    re.compile(pattern)
    return f"(?Ud){pattern}"
