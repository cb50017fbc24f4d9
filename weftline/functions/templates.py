"""Message templates as columns.

A template is text with actions in double braces: ``{{.Field}}``, nested ``{{.Customer.Name}}``, ``{{if .X}} … {{else if
eq .Y "z"}} … {{else}} … {{end}}``, ``{{range .Items}} … {{else}} … {{end}}`` and ``{{with .Customer}} … {{end}}``, in
whose bodies ``.`` is the item and ``$`` the row, and ``{{/* comments */}}``; ``{{-`` and ``-}}`` take the white space
beside them away.  A whole template becomes one expression for its text and one for what is wrong with a row; no
Python runs.

As in the language's own rules, false, 0, "", NULL and empty lists and maps do not hold.  A row fails where a field of
something NULL is asked for.  Fields match by name, in snake_case or PascalCase; unknown ones are an error when the
plan is made.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ACTION = re.compile(r"\{\{(-\s)?\s*(.*?)\s*(\s-)?\}\}", re.S)
_WORD = re.compile(r'"(?:[^"\\]|\\.)*"|`[^`]*`|\(|\)|[^\s()]+')
# The comparisons of the language.
COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}


@dataclass
class Block:
    """A part of a template: text or an action, with the parts inside it."""

    kind: str
    text: str = ""
    body: list[Block] = field(default_factory=list)
    other: list[Block] = field(default_factory=list)


@dataclass
class Value:
    """An operand: its column, its type, and where (if anywhere) asking for it fails."""

    column: Column
    kind: T.DataType
    error: Column | None = None


def parts_of(template: str) -> list[Block]:
    """The template as nested blocks."""
    top = Block("top")
    stack: list[tuple[Block, list[Block]]] = [(top, top.body)]
    last, strip = 0, False
    for m in _ACTION.finditer(template):
        text = template[last : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[1] else text
        last, strip = m.end(), bool(m[3])
        if text:
            stack[-1][1].append(Block("text", text))
        action = m[2]
        if action.startswith("/*"):
            continue
        word, _, rest = action.partition(" ")
        if word in ("if", "range", "with"):
            block = Block(word, rest.strip())
            stack[-1][1].append(block)
            stack.append((block, block.body))
        elif word == "else":
            block = stack[-1][0]
            if block.kind == "top" or stack[-1][1] is block.other:
                raise ValueError("template: {{else}} without {{if}}")
            stack[-1] = (block, block.other)
            inner, _, condition = rest.strip().partition(" ")
            if inner in ("if", "with"):  # closed by the same end
                chained = Block(inner + "+", condition.strip())
                block.other.append(chained)
                stack.append((chained, chained.body))
        elif word == "end":
            while stack[-1][0].kind.endswith("+"):
                stack.pop()
            if len(stack) == 1:
                raise ValueError("template: {{end}} without a beginning")
            stack.pop()
        elif action:
            stack[-1][1].append(Block("value", action))
    if len(stack) > 1:
        raise ValueError(f"template: {{{{{stack[-1][0].kind.rstrip('+')}}}}} without {{{{end}}}}")
    tail = template[last:].lstrip() if strip else template[last:]
    if tail:
        top.body.append(Block("text", tail))
    return top.body


def _any(errors: list[Column | None]) -> Column | None:
    found = [e for e in errors if e is not None]
    return F.coalesce(*found) if found else None


def _same_name(a: str, b: str) -> bool:
    return a.lower() == b.lower() or a.replace("_", "").lower() == b.replace("_", "").lower()


def _step(value: Value, name: str, path: str) -> Value:
    """A field of a value."""
    if isinstance(value.kind, T.StructType):
        exact = [f for f in value.kind.fields if f.name.lower() == name.lower()]
        found = exact or [f for f in value.kind.fields if _same_name(f.name, name)]
        if not found:
            raise ValueError(f"template field {path!r} is not a column")
        got = value.column.getField(found[0].name)
        kind = found[0].dataType
    elif isinstance(value.kind, T.MapType):
        got, kind = F.try_element_at(value.column, F.lit(name)), value.kind.valueType
        return Value(got, kind, value.error)  # a map that is NULL has no key, which is no error
    else:
        raise ValueError(f"template field {path!r} is not a column")
    nothing = F.when(value.column.isNull(), F.lit(f"{path}: its parent is NULL"))
    return Value(got, kind, _any([value.error, nothing]))


class _Scope:
    """What ``.`` and ``$`` stand for."""

    def __init__(self, dot: Value | T.StructType, row: T.StructType):
        self.dot, self.row = dot, row

    def column(self, path: str) -> Value:
        names = [n for n in path.lstrip("$").split(".") if n]
        at_row = path.startswith("$") or isinstance(self.dot, T.StructType)
        if not at_row:
            value = self.dot
        elif not names:
            return Value(F.to_json(F.struct("*")), T.StringType())
        else:
            exact = [f for f in self.row.fields if f.name.lower() == names[0].lower()]
            found = exact or [f for f in self.row.fields if _same_name(f.name, names[0])]
            if not found:
                raise ValueError(f"template field {names[0]!r} is not a column")
            value = Value(F.col(f"`{found[0].name}`"), found[0].dataType)
            names = names[1:]
        for name in names:
            value = _step(value, name, path)
        return value


def _literal(word: str) -> Value | None:
    if word[0] in '"`':
        return Value(F.lit(word[1:-1] if word[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1])), T.StringType())
    if word in ("true", "false"):
        return Value(F.lit(word == "true"), T.BooleanType())
    if re.fullmatch(r"-?\d+", word):
        return Value(F.lit(int(word)), T.LongType())
    if re.fullmatch(r"-?\d*\.\d+", word):
        return Value(F.lit(float(word)), T.DoubleType())
    return None


def _pipeline(text: str, scope: _Scope) -> Value:
    """A value, or a function and its operands; parentheses group."""
    words, at = _WORD.findall(text), 0

    def one() -> Value:
        nonlocal at
        if at >= len(words):
            raise ValueError(f"template: {text!r} is not complete")
        word = words[at]
        at += 1
        if word == "(":
            value = call()
            if at >= len(words) or words[at] != ")":
                raise ValueError(f"template: {text!r} lacks a parenthesis")
            at += 1
            return value
        found = _literal(word)
        if found is None and not word.startswith((".", "$")):
            raise ValueError(f"template: {word!r} is no field, value or function")
        return found or scope.column(word)

    def call() -> Value:
        nonlocal at
        word = words[at] if at < len(words) else ""
        if word not in COMPARE and word not in ("not", "and", "or", "len", "upper", "lower"):
            return one()
        at += 1
        args = []
        while at < len(words) and words[at] != ")":
            args.append(one())
        if not args or word in ("not", "len", "upper", "lower") and len(args) != 1 or word in COMPARE and len(args) < 2:
            raise ValueError(f"template: wrong number of operands in {text!r}")
        error = _any([a.error for a in args])
        if word in COMPARE:
            pairs = [COMPARE[word](*_alike(args[0], other)) for other in args[1:]]  # eq of several: any of them
            held = pairs[0]
            for p in pairs[1:]:
                held = held | p
            return Value(F.coalesce(held, F.lit(word == "ne")), T.BooleanType(), error)
        if word == "not":
            return Value(~truth(args[0]), T.BooleanType(), error)
        if word in ("and", "or"):
            held = truth(args[0])
            for a in args[1:]:
                held = held & truth(a) if word == "and" else held | truth(a)
            return Value(held, T.BooleanType(), error)
        if word == "len":
            return Value(F.length(args[0].column) if isinstance(args[0].kind, T.StringType) else F.coalesce(F.size(args[0].column), F.lit(0)), T.IntegerType(), error)
        return Value((F.upper if word == "upper" else F.lower)(args[0].column.cast("string")), T.StringType(), error)

    value = call()
    if at < len(words):
        raise ValueError(f"template: {text!r} has more than one value")
    return value


def _alike(a: Value, b: Value) -> tuple[Column, Column]:
    numbers = [isinstance(x.kind, T.NumericType) for x in (a, b)]
    if a.kind == b.kind or all(numbers):
        return a.column, b.column
    return a.column.cast("string"), b.column.cast("string")


def truth(value: Value) -> Column:
    """Whether a value holds."""
    c, kind = value.column, value.kind
    if isinstance(kind, T.BooleanType):
        held = c
    elif isinstance(kind, T.NumericType):
        held = c != 0
    elif isinstance(kind, T.StringType):
        held = c != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        held = F.size(c) > 0
    else:
        held = c.isNotNull()
    return F.coalesce(held, F.lit(False))


def _printed(value: Value) -> Column:
    kind = value.kind
    text = F.to_json(value.column) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.column.cast("string")
    return F.coalesce(text, F.lit(""))


def _compiled(blocks: list[Block], scope: _Scope) -> tuple[Column, Column | None]:
    texts, errors = [F.lit("")], []
    for b in blocks:
        if b.kind == "text":
            texts.append(F.lit(b.text))
            continue
        value = _pipeline(b.text, scope)
        kind = b.kind.rstrip("+")
        if kind == "value":
            texts.append(_printed(value))
            errors.append(value.error)
            continue
        errors.append(value.error)
        no, no_error = _compiled(b.other, scope)
        if kind == "range":
            if not isinstance(value.kind, T.ArrayType):
                raise ValueError(f"template: {{{{range {b.text}}}}} needs a list")
            fails: list[Column | None] = []

            def part(number: int, kind=value.kind.elementType, body=b.body):
                """The text (0) or the error (1) of the body, as a function of the item alone."""

                def of(item: Column) -> Column:
                    made = _compiled(body, _Scope(Value(item, kind), scope.row))
                    fails.append(made[1])
                    return made[number] if made[number] is not None else F.lit(None).cast("string")

                return of

            held = truth(value)
            yes = F.array_join(F.transform(value.column, part(0)), "")
            first = F.try_element_at(F.filter(F.transform(value.column, part(1)), lambda e: e.isNotNull()), F.lit(1))
            yes_error = first if any(e is not None for e in fails) else None
        else:
            held = truth(value)
            yes, yes_error = _compiled(b.body, _Scope(Value(value.column, value.kind), scope.row) if kind == "with" else scope)
        texts.append(F.when(held, yes).otherwise(no))
        if yes_error is not None:
            errors.append(F.when(held, yes_error))
        if no_error is not None:
            errors.append(F.when(~held, no_error))
    return F.concat(*texts), _any(errors)


def compiled(template: str, schema: T.StructType) -> tuple[Column, Column]:
    """(text, error) of a template over rows of a schema; the error is NULL where the row is fine."""
    text, error = _compiled(parts_of(template), _Scope(schema, schema))
    return text, error if error is not None else F.lit(None).cast("string")
