"""JSON text rewritten inside the JVM: canonical form, equal spelling, leaves and printed values, at any depth.

A text is split at its quotation marks (escaped ones are masked first; the masks are
control characters, which JSON text can't hold), so every other part is a string and the
rest is punctuation, numbers and words, which a function rewrites one by one. Nothing here
needs a Python worker, and all text may be of any depth. Texts are JSON as its standard
has it: no NaN, no repeated names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Stand for an escaped backslash, an escaped quotation mark, and the number that a string stands for.
_SLASH, _QUOTE = "\x01", "\x02"
_NUMBER = "\\u0003"
_CUTS = r"(?<=[\[\]{},:\s])|(?=[\[\]{},:\s])"


def parsed(text: Column) -> Column:
    """The VARIANT of a whole JSON text; null if it isn't one, also where something follows the value.

    The parser stops behind the first value, so the text is parsed as the only element of
    a list, and as a member: no text can close both early.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    items = F.try_variant_get(alone, "$", "array<variant>")
    return F.when(member.isNotNull() & (F.size(items) == 1), F.get(items, F.lit(0)))


def quoted_tokens(part: Column, token: str, replacement: str) -> Column:
    """A part between strings with its numbers or words that match ``token`` replaced in one pass; $1 is the token."""
    return F.regexp_replace(part, rf"(?<![^\[\]{{}},:\s])({token})(?![^\[\]{{}},:\s])", replacement)


def rewritten(text: Column, literal: Callable[[Column], Column], string: Callable[[Column], Column] | None = None, comma: str = ",", colon: str = ":", quick: Callable[[Column], Column] | None = None) -> Column:
    """``text`` without blanks, each number or word by ``literal``, each string with its marks by ``string`` (which sees the masks).

    ``quick`` rewrites a whole part between strings, its blanks left in, or gives null for
    ``literal`` to do it token by token.
    """
    masked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def outside(part: Column) -> Column:
        token = lambda t: F.when(t.rlike(r"^\s*$"), "").when(t == ",", comma).when(t == ":", colon).when(t.isin("[", "]", "{", "}"), t).otherwise(literal(t))
        slow = F.array_join(F.transform(F.split(part, _CUTS), token), "")
        if not quick:
            return slow
        # most parts are a colon or a comma; the others' tokens are replaced by patterns where these say all
        return F.when(part.isin(":", ",", "{", "}", "[", "]", ""), part).otherwise(F.coalesce(F.regexp_replace(quick(part), r"\s+", ""), slow))

    inside = string or (lambda s: F.concat(F.lit('"'), s, F.lit('"')))
    parts = F.transform(F.split(masked, '"', -1), lambda x, i: F.when(i % 2 == 1, inside(x)).otherwise(outside(x)))
    return unmasked(F.array_join(parts, ""))


def unmasked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))


def whole(number: Column) -> Column:
    return number.rlike(r"^-?[0-9]+$")


def python_int(number: Column) -> Column:
    return F.when(number == "-0", "0").otherwise(number)


def python_float(number: Column) -> Column:
    """A JSON number with a point or an exponent as Python prints it: the fewest digits that give the same double.

    Java's digits are taken, and cut by one or two where the rounded rest gives the same
    double (Java 17 prints some doubles with more digits than they need).
    """
    step = lambda rows, f: F.transform(rows, f)  # noqa: E731  one struct at a time, so that no part is computed twice
    fields = lambda **parts: F.struct(*[c.alias(name) for name, c in parts.items()])
    value = number.cast("double")
    shown = step(F.array(value), lambda d: fields(d=d, s=F.regexp_replace(d.cast("string"), "^-", ""), minus=F.when(d.cast("string").startswith("-"), "-").otherwise("")))
    split = step(shown, lambda x: fields(
        d=x["d"], minus=x["minus"], s=x["s"], head=F.regexp_extract(x["s"], r"^([0-9]+)", 1), tail=F.regexp_extract(x["s"], r"\.([0-9]+)", 1),
        e=F.coalesce(F.regexp_extract(x["s"], r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0)),
    ))
    digits = step(split, lambda x: fields(d=x["d"], minus=x["minus"], s=x["s"], raw=F.concat(x["head"], x["tail"]), point=F.length(x["head"]) + x["e"]))
    digits = step(digits, lambda x: fields(d=x["d"], minus=x["minus"], s=x["s"], raw=F.regexp_replace(x["raw"], "^0+", ""), point=x["point"] - F.length(x["raw"]) + F.length(F.regexp_replace(x["raw"], "^0+", ""))))
    digits = step(digits, lambda x: fields(d=x["d"], minus=x["minus"], s=x["s"], raw=F.regexp_replace(x["raw"], "0+$", ""), point=x["point"]))

    def shorter(x: Column) -> Column:
        """One digit less, rounded, if it is the same double."""
        size = F.length(x["raw"])
        cut = F.floor((x["raw"].cast("decimal(20,0)") + 5) / 10).cast("decimal(20,0)").cast("string")
        made = fields(cut=cut, point=x["point"] + F.length(cut) - size + 1)
        same = lambda m: F.concat(x["minus"], F.lit("0."), m["cut"], F.lit("E"), m["point"].cast("string")).cast("double") == x["d"]
        kept = fields(d=x["d"], minus=x["minus"], s=x["s"], raw=x["raw"], point=x["point"])
        tried = F.transform(F.array(made), lambda m: F.when(same(m), fields(d=x["d"], minus=x["minus"], s=x["s"], raw=F.regexp_replace(m["cut"], "0+$", ""), point=m["point"])).otherwise(kept))
        return F.when(size > 1, F.get(tried, F.lit(0))).otherwise(kept)

    digits = step(step(digits, shorter), shorter)

    def printed(x: Column) -> Column:
        raw, point, size = x["raw"], x["point"], F.length(x["raw"])
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), raw)
        large = F.concat(raw, F.repeat(F.lit("0"), point - size), F.lit(".0"))
        between = F.concat(F.substring(raw, F.lit(1), point), F.lit("."), F.substring(raw, point + 1, size))
        power = F.concat(F.when(point < 1, "-").otherwise("+"), F.lpad(F.abs(point - 1).cast("string"), F.greatest(F.lit(2), F.length(F.abs(point - 1).cast("string"))), F.lit("0")))
        science = F.concat(F.substring(raw, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substring(raw, F.lit(2), size))).otherwise(""), F.lit("e"), power)
        plain = F.when(point <= 0, small).when(point >= size, large).otherwise(between)
        text = F.when(x["s"].isin("Infinity", "NaN"), x["s"]).when(size == 0, "0.0").when((point > -4) & (point <= 16), plain).otherwise(science)
        return F.concat(x["minus"], text)

    return F.get(step(digits, printed), F.lit(0))


def python_number(number: Column) -> Column:
    return F.when(whole(number), python_int(number)).otherwise(python_float(number))


def _marked(literal: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Numbers as strings that say so: a VARIANT keeps strings as they are, but no number's spelling."""
    mark = lambda t: F.concat(F.lit(f'"{_NUMBER}'), literal(t), F.lit('"'))
    return lambda t: F.when(t.rlike(r"^-?[0-9]"), mark(t)).otherwise(t)


def _sorted(text: Column) -> Column:
    """Compact text with the names of every object in the order of their characters' code points."""
    once = lambda t: F.to_json(F.parse_json(t))
    # names are sorted by UTF-16 units; where that may differ, the bytes of UTF-8 stand for characters
    odd = text.rlike(r"[\x{10000}-\x{10FFFF}]|\\u[dD][89abAB]") & text.rlike(r"[\x{E000}-\x{FFFF}]|\\u[eEfF]")
    spread = F.decode(F.encode(once(text), "UTF-8"), "ISO-8859-1")
    return F.when(odd, F.decode(F.encode(once(spread), "ISO-8859-1"), "UTF-8")).otherwise(once(text))


def _known(text: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("no JSON: "), F.substring(text, 1, 80))).cast("string")
    return F.when(parsed(text).isNotNull(), text).when(text.isNotNull(), wrong)


def _ordered(text: Column) -> Column:
    """Sorted compact text whose numbers, as Python prints them, are marked strings."""
    known = _known(text)
    return _sorted(F.when(known.rlike(r"[0-9]"), rewritten(known, _marked(python_number))).otherwise(known))


def _spaced(ordered: Column) -> Column:
    number = f"^{chr(92) * 2}u0003"
    string = lambda s: F.when(s.rlike(number), F.substring(s, F.lit(len(_NUMBER) + 1), F.length(s))).otherwise(F.concat(F.lit('"'), _short_escapes(s), F.lit('"')))
    return rewritten(ordered, lambda t: t, string, ", ", ": ")


def canonical(text: Column) -> Column:
    """The canonical form of JSON text: names sorted, ", " and ": " between, no escapes but those needed, numbers as Python prints them.

    Null stays null; a text that is no JSON is an error.
    """
    return _spaced(_ordered(text))


def canonical_member(text: Column, name: str) -> Column:
    """The canonical form of one member of an object; null if it hasn't this member or isn't one."""
    return _spaced(F.to_json(F.try_variant_get(F.parse_json(_ordered(text)), f"$.{name}", "variant")))


def _short_escapes(s: Column) -> Column:
    """Control characters escaped with small digits, as Python does."""
    low = s
    for digit in "ABCDEF":
        low = F.regexp_replace(low, rf"(\\u00[01]){digit}", f"$1{digit.lower()}")
    return F.when(s.contains("\\u00"), low).otherwise(s)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical(text).cast("binary"), 256)


def json_string(value: Column) -> Column:
    """A string as canonical JSON; null is the word null."""
    listed = F.transform(F.array(value), lambda v: F.struct(v.alias("v"), F.to_json(F.array(v)).alias("text")))
    return F.get(F.transform(listed, lambda x: F.when(x["v"].isNull(), "null").otherwise(unmasked(_short_escapes(F.replace(F.substring(x["text"], F.lit(2), F.length(x["text"]) - 2), F.lit("\\\\"), F.lit(_SLASH)))))), F.lit(0))


def equal_number(number: Column, broken: Callable[[Column], Column] = lambda number: number.cast("double").cast("string")) -> Column:
    """One spelling of all numbers that are equal: whole ones by their digits, however they are written, others by ``broken``."""
    d = number.cast("double")
    integral = (F.abs(d) < 9.2e18) & (d == F.floor(d).cast("double"))
    return F.when(whole(number), python_int(number)).when(integral, d.cast("long").cast("string")).otherwise(broken(number))


def equal_form(text: Column) -> Column:
    """JSON text in which equal values look alike once parsed: 1, 1.0 and true are one number; whole numbers are exact."""
    literal = lambda t: F.when(t == "true", f'"{_NUMBER}1"').when(t == "false", f'"{_NUMBER}0"').otherwise(_marked(equal_number)(t))

    def quick(part: Column) -> Column:
        """Whole numbers, also those that end in .0, and words; a part with other numbers is not for patterns."""
        plain = F.regexp_replace(part, r"(?<![^\[\]{},:\s])(-?[0-9]{1,15})\.0{1,9}(?![^\[\]{},:\s])", "$1")
        mark = lambda p, token, text: quoted_tokens(p, token, f'"{chr(92)}{_NUMBER}{text}"')
        made = mark(mark(mark(plain, "true", "1"), "false", "0"), "-?[0-9]+", "$1")
        return F.when(~plain.rlike(r"[0-9][.eE]|-0"), made)

    # texts without points, exponents, booleans and very long numbers are what they seem
    odd = text.rlike(r"[0-9][.eE]|true|false|-0|[0-9]{18}")
    return F.when(odd, rewritten(text, literal, quick=quick)).otherwise(text)


def _shown(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.to_json(value), F.lit("null")), f'"{chr(92) * 2}u0003([^"]*)"', "$1")


def leaves(text: Column, depth: int) -> Column:
    """What an object says, as an array of texts "path=value", with members of members up to ``depth`` levels.

    An object is a leaf "path={}" and its members are leaves of their own; a list, a
    string, a number or a null is one leaf. Numbers that are equal give equal leaves.
    Deeper members are left out. Null if the text isn't a JSON object.
    """
    members = lambda v: F.try_variant_get(v, "$", "map<string,variant>")

    def nodes(path: Column, own: Column) -> Column:
        return F.transform(F.map_entries(own), lambda m: F.struct(F.concat(path, F.to_json(F.array(m["key"]))).alias("path"), m["value"].alias("value"), members(m["value"]).alias("own")))

    shown = lambda level: F.transform(level, lambda n: F.concat(n["path"], F.lit("="), F.when(n["own"].isNotNull(), "{}").otherwise(_shown(n["value"]))))
    inner = lambda level: F.flatten(F.transform(F.filter(level, lambda n: n["own"].isNotNull()), lambda n: nodes(n["path"], n["own"])))
    state = F.transform(F.array(members(F.try_parse_json(equal_form(text)))), lambda own: F.struct(F.array().cast("array<string>").alias("found"), nodes(F.lit(""), own).alias("level")))
    for _ in range(depth - 1):
        state = F.transform(state, lambda s: F.struct(F.concat(s["found"], shown(s["level"])).alias("found"), inner(s["level"]).alias("level")))
    return F.get(F.transform(state, lambda s: F.concat(s["found"], shown(s["level"]))), F.lit(0))


def depth_of(text: Column) -> Column:
    """How many objects lie in one another in a JSON text, the outermost included."""
    masked = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    braces = F.split(F.regexp_replace(F.regexp_replace(masked, '"[^"]*"', ""), "[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, brace: Column) -> Column:
        now = s["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(braces, zero, step)["most"]


def deeper(text: Column, depth: int) -> Column:
    """Whether more than ``depth`` objects lie in one another; a text with no more braces needs no count."""
    return (F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))) > depth) & (depth_of(text) > depth)


def wanted_leaves(matcher: Column, depth: int) -> Column:
    """The leaves that args must have. Nothing, an empty object and other empty values ask for none; any other value can't be met.

    A matcher deeper than ``depth`` is an error: it would be met by too little.
    """
    nothing = F.coalesce(F.regexp_replace(matcher, r"\s", ""), F.lit("{}")).isin("{}", "null", "[]", '""', "0", "false", "")
    deep = F.raise_error(F.concat(F.lit(f"deeper than {depth} levels: "), F.substring(matcher, 1, 80))).cast("array<string>")
    return F.when(nothing, F.array().cast("array<string>")).when(deeper(matcher, depth), deep).otherwise(F.coalesce(leaves(matcher, depth), F.array(F.lit("="))))


def met(wanted: Column, have: Column) -> Column:
    """Whether all wanted leaves are among those of the args; args that are no object have none."""
    return F.size(F.array_except(wanted, F.coalesce(have, F.array().cast("array<string>")))) == 0
