"""Values that a schema allows, found by trying: the first candidate that the validator accepts.

What a schema itself gives (constants, enumerations, examples, defaults, branches) is
tried first, then what its limits suggest, then plain values of its types. ``spoiled``
gives a value that it doesn't allow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

from .validator import Validator

#: Samples of formats, wrong values of types, and outputs that say they are malformed (fixed values).
FORMAT_SAMPLES = {"date": "2026-01-15", "date-time": "2026-01-15T10:00:00Z", "email": "user@example.com"}
WRONG_VALUES = {"integer": "not-a-number", "number": "not-a-number", "boolean": "yes", "object": "free text instead of structured data", "array": "free text instead of structured data"}
OTHERWISE_WRONG = 12345
MALFORMED = {"error": "malformed tool output"}
PLAIN_STRING = "example"

#: So many candidates of a schema are tried.
TRIES = 32


def types_of(schema: dict) -> list[str]:
    """The types a schema names, null last; without a name, what its keywords are about."""
    named = schema.get("type")
    named = [named] if isinstance(named, str) else list(named or ())
    told = [kind for kind, word in (("object", "properties"), ("array", "items")) if word in schema]
    return sorted(named or told or ["string"], key="null".__eq__)


def suggested(schema: dict, kind: str, name: str, check: Validator) -> Iterator[object]:
    """Candidates of one type, the likeliest first."""
    given = lambda *keys: [schema[k] for k in keys if isinstance(schema.get(k), (int, float))]
    if kind in ("integer", "number"):
        numbers = [*given("default", "minimum"), *(x + 1 for x in given("exclusiveMinimum")), 1, *given("maximum"), *(x - 1 for x in given("exclusiveMaximum")), 0]
        yield from numbers if kind == "integer" else map(float, numbers)
    elif kind == "string":
        yield from filter(None, [FORMAT_SAMPLES.get(schema.get("format"))])
        yield from ("1" * int(n) for n in re.findall(r"\{(\d+)", schema.get("pattern") or ""))
        own, least = name or PLAIN_STRING, schema.get("minLength") or 0
        padded = own if len(own) >= least else f"{own}{f'-{PLAIN_STRING}' * least}"[:least]
        yield padded[: schema.get("maxLength")]
    elif kind == "array":
        yield [found(schema.get("items") or {"type": "string"}, name, check)] * max(1, schema.get("minItems") or 1)
    elif kind == "object":
        yield {member: found(sub, member, check) for member, sub in (schema.get("properties") or {}).items()}
    elif kind == "boolean":
        yield True


def candidates(schema: dict, name: str, check: Validator) -> Iterator[object]:
    for key in ("const", "enum", "examples"):
        yield from [schema[key]] if key == "const" and key in schema else schema.get(key, ())
    branches = [b for key in ("anyOf", "oneOf") for b in schema.get(key, ())]
    for branch in sorted(branches, key=lambda b: check.resolve(b).get("type") == "null"):
        yield found(branch, name, check)
    if "allOf" in schema:
        yield found(dict(chain.from_iterable(check.resolve(part).items() for part in schema["allOf"])), name, check)
    for kind in types_of(schema):
        yield from suggested(schema, kind, name, check)


def found(schema: dict, name: str, check: Validator) -> object:
    """The first candidate without a problem, else the first one, else null."""
    if not schema:
        return {}
    schema = check.resolve(schema)
    tried = list(islice(candidates(schema, name, check), TRIES))
    return next((c for c in tried if not any(check.walk(c, schema, "$"))), tried[0] if tried else None)


def sample(schema: dict) -> object:
    return found(schema or {}, "", Validator(schema or {}))


def spoiled(schema: dict, how: str = "missing_required") -> object:
    """A sample without its first required member, or (``wrong_type``) with a value of another type there."""
    if not schema:
        return dict(MALFORMED)
    check = Validator(schema)
    root, good = check.resolve(schema), sample(schema)
    if not (isinstance(good, dict) and good):
        return f"malformed: {good}"
    at = [*(r for r in root.get("required") or () if r in good), *good][0]
    others = {member: v for member, v in good.items() if member != at}
    if how != "wrong_type":
        return others
    kind = types_of(check.resolve((root.get("properties") or {}).get(at, {})))[0]
    return {**good, at: WRONG_VALUES.get(kind, OTHERWISE_WRONG)}
