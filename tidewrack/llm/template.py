"""A sandboxed template language for conversations, compiled to Python closures.

Source becomes a syntax tree, constants are folded in it (expressions of
constants, branches that can't be taken, neighbouring texts), and each node
becomes a closure over its parts, so nothing is interpreted while rendering.

    text   {{ expression }}   {# comment #}   {%- and -%} strip white space
    {% for m in messages %} ... {% endfor %}      at the top level, once
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = e %}   {% generation %} ... {% endgeneration %}

Expressions: strings, whole numbers, true, false, none, names, m.role or
m['role'], == != < <= > >= in, not in, and, or, not, + (sums, joins), ~ (joins
as text), a if c else b, and the filters below after |. In the loop, loop has
index, index0, first, last, previtem and nextitem.

Sandbox: there are no calls, no attributes of Python objects (only keys of
messages and of loop), no loops but the one over messages, and no names but
those given, set or looped over; anything else is a TemplateError when the
template is compiled. What a name or key doesn't hold is none, which prints as
nothing. Output is at most the template's own text and its values for each
message, so neither time nor memory can be blown up by a template.

A rendering is a stream: messages come one by one, with a look at the next, and
parts of the output leave as soon as they are long enough, cut between
messages. Generation markers give the spans, in code points, of what they hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template says something that the language doesn't have."""


class Guard:
    r"""Makes texts free of control strings, reversibly: \ is doubled, and one is put behind the first character of each control string."""

    def __init__(self, controls: Iterable[str]):
        self.controls = sorted(set(controls), key=lambda c: (-len(c), c))
        for c in self.controls:
            if len(c) < 2 or "\\" in c:
                raise TemplateError(f"a control string needs two characters, none of them \\: {c!r}")
            if any(d[k:].startswith(c[: len(d) - k]) for d in self.controls for k in range(1, len(d))):
                raise TemplateError(f"text before {c!r} could make another control string with it")
        either = "|".join(map(re.escape, self.controls)) or "(?!)"
        self.pattern, self._first = re.compile(f"({either})"), re.compile(f"(?=(?:{either}))(.)", re.S)

    def escape(self, text: str) -> str:
        return self._first.sub(r"\1\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)


# ---- syntax tree ----


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """What: an operator, "filter:<name>", "get", "and", "or" or "pick" (condition, then, otherwise)."""

    what: str
    parts: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class Branch:
    test: Any
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class Put:
    name: str
    value: Any


@dataclass(frozen=True)
class Marked:
    body: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


def text_of(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else ""


def _sum(a: Any, b: Any) -> Any:
    return a + b if type(a) is int and type(b) is int else text_of(a) + text_of(b)


def _ordered(f: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    return lambda a, b: type(a) is type(b) and isinstance(a, str | int) and f(a, b)


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _ordered(lambda a, b: a < b), "<=": _ordered(lambda a, b: a <= b), ">": _ordered(lambda a, b: a > b), ">=": _ordered(lambda a, b: a >= b),
    "in": lambda a, b: isinstance(a, str) and a in b if isinstance(b, str | dict) else False, "not": lambda a: not a, "+": _sum, "~": lambda a, b: text_of(a) + text_of(b),
    "get": lambda a, k: a.get(k) if isinstance(a, dict) else None,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda x: text_of(x).strip(), "upper": lambda x: text_of(x).upper(), "lower": lambda x: text_of(x).lower(), "length": lambda x: len(text_of(x)),
    "default": lambda x, d: d if x is None else x,
}
WORDS = {"true": True, "false": False, "none": None}
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-<>()\[\].|,~+=]))""", re.S)
_BLOCK = re.compile(r"(\s*\{([%{#])-|\{([%{#]))(.*?)(?:-([%}#])\}\s*|([%}#])\})", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.source, self.tokens, at, end = source, [], 0, len(source.rstrip())
        while at < end:
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            at = m.end()
            s, n, w, o = m.groups()
            self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPED.get(x[1], x[1]), s[1:-1], flags=re.S)) if s else ("const", int(n)) if n else ("const", WORDS[w]) if w in WORDS else ("word", w) if w else ("sign", o))
        self.at = 0

    def next_is(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)
        if kind != "const" and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.next_is(value):
            raise TemplateError(f"{value!r} is missing in {self.source!r}")

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"a name is missing in {self.source!r}")

    def whole(self) -> Any:
        e = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much in {self.source!r}")
        return e

    def choice(self) -> Any:
        e = self.either()
        if self.next_is("if"):
            test = self.either()
            return Apply("pick", (test, e, self.choice() if self.next_is("else") else Const(None)))
        return e

    def either(self) -> Any:
        e = self.both()
        while self.next_is("or"):
            e = Apply("or", (e, self.both()))
        return e

    def both(self) -> Any:
        e = self.negated()
        while self.next_is("and"):
            e = Apply("and", (e, self.negated()))
        return e

    def negated(self) -> Any:
        return Apply("not", (self.negated(),)) if self.next_is("not") else self.compared()

    def compared(self) -> Any:
        e = self.joined()
        while what := self.next_is("==", "!=", "<", "<=", ">", ">=", "in", "not"):
            if what == "not":
                self.need("in")
                e = Apply("not", (Apply("in", (e, self.joined())),))
            else:
                e = Apply(what, (e, self.joined()))
        return e

    def joined(self) -> Any:
        e = self.filtered()
        while what := self.next_is("+", "~"):
            e = Apply(what, (e, self.filtered()))
        return e

    def filtered(self) -> Any:
        e = self.value()
        while True:
            if self.next_is("."):
                e = Apply("get", (e, Const(self.word())))
            elif self.next_is("["):
                e = Apply("get", (e, self.choice()))
                self.need("]")
            elif self.next_is("|"):
                name, rest = self.word(), []
                if self.next_is("("):
                    rest = [self.choice()]
                    while self.next_is(","):
                        rest.append(self.choice())
                    self.need(")")
                e = Apply(f"filter:{name}", (e, *rest))
            else:
                return e

    def value(self) -> Any:
        if self.next_is("("):
            e = self.choice()
            self.need(")")
            return e
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        return Name(self.word())


def _blocks(source: str) -> Iterator[tuple[str, str]]:
    """("text", ...), ("{", expression) and ("%", statement)."""
    at = 0
    for m in _BLOCK.finditer(source):
        kind, end = m[2] or m[3], m[5] or m[6]
        if end != {"{": "}"}.get(kind, kind):
            raise TemplateError(f"{m[0]!r} ends with another sign than it begins with")
        if m.start() > at:
            yield "text", source[at : m.start()]
        at = m.end()
        if kind != "#":
            yield kind, m[4].strip()
    if re.search(r"\{[%{#]", source[at:]):
        raise TemplateError(f"{source[at:]!r} has no end")
    yield "text", source[at:]


class _Statements:
    def __init__(self, source: str):
        self.blocks, self.at = list(_blocks(source)), 0
        self.looped = self.marking = False

    def until(self, *ends: str, top: bool = False) -> tuple[tuple, str]:
        """The statements up to one of ends, and that end."""
        out: list = []
        while self.at < len(self.blocks):
            kind, said = self.blocks[self.at]
            self.at += 1
            if kind == "text":
                out.append(Text(said))
                continue
            if kind == "{":
                out.append(Print(_Expression(said).whole()))
                continue
            word, _, rest = said.partition(" ")
            if word in ends:
                return tuple(out), said
            if word == "if":
                out.append(self.branch(rest))
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"can't read {said!r}")
                out.append(Put(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                if self.marking:
                    raise TemplateError("a generation can't stand in another")
                self.marking = True
                out.append(Marked(self.until("endgeneration")[0]))
                self.marking = False
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                if not m or not top or self.looped:
                    raise TemplateError("the one loop is that over messages, at the top level")
                self.looped = True
                out.append(Loop(m[1], self.until("endfor")[0]))
            else:
                raise TemplateError(f"can't read {said!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def branch(self, test: str) -> Branch:
        then, end = self.until("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        otherwise = (self.branch(rest),) if word == "elif" else self.until("endif")[0] if word == "else" else ()
        return Branch(_Expression(test).whole(), then, otherwise)


# ---- folding and closures ----


@dataclass
class Out:
    """What a rendering has written since its last part."""

    texts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0
    turns: int = 0

    def write(self, s: str) -> None:
        self.texts.append(s)
        self.size += len(s)


@dataclass(frozen=True)
class Part:
    text: str
    spans: list[tuple[int, int]]
    turns: int
    last: bool


class Template:
    """A compiled template. constants: names with values known now. controls: strings that the guard filter keeps out of texts."""

    def __init__(self, source: str, constants: dict[str, Any] | None = None, controls: Iterable[str] = ()):
        self.guard, self.constants = Guard(controls), dict(constants or {})
        if bad := [k for k, v in self.constants.items() if not isinstance(v, str | int | None)]:
            raise TemplateError(f"constants are texts and numbers: {bad}")
        self.filters = FILTERS | {"guard": lambda x: self.guard.escape(text_of(x))}
        self.tree = self.body(_Statements(source).until(top=True)[0])
        at = next((i for i, x in enumerate(self.tree) if isinstance(x, Loop)), len(self.tree))
        names = self.names(self.tree[:at], set())
        self._before = self.run(self.tree[:at], set())
        loop = self.tree[at] if at < len(self.tree) else None
        self._name = loop.name if loop else ""
        self._body = self.run(loop.body, names | {loop.name, "loop"}) if loop else self.run((), set())
        self._after = self.run(self.tree[at + 1 :], names)

    @staticmethod
    def names(body: tuple, known: set[str]) -> set[str]:
        """known and the names that body sets, in whatever branch."""
        for x in body:
            known = known | {x.name} if isinstance(x, Put) else Template.names(x.then, known) | Template.names(x.otherwise, known) if isinstance(x, Branch) else Template.names(x.body, known) if isinstance(x, Marked) else known
        return known

    def fold(self, e: Any) -> Any:
        if isinstance(e, Name):
            return Const(self.constants[e.name]) if e.name in self.constants else e
        if not isinstance(e, Apply):
            return e
        parts = tuple(map(self.fold, e.parts))
        first = parts[0]
        if e.what in ("and", "or") and isinstance(first, Const):
            return parts[1] if bool(first.value) == (e.what == "and") else first
        if e.what == "pick":
            return Apply(e.what, parts) if not isinstance(first, Const) else parts[1] if first.value else parts[2]
        if e.what not in ("and", "or") and all(isinstance(x, Const) for x in parts):
            return Const(self.function(e)(*(x.value for x in parts)))
        return Apply(e.what, parts)

    def function(self, e: Apply) -> Callable:
        if not e.what.startswith("filter:"):
            return OPERATORS[e.what]
        name = e.what.removeprefix("filter:")
        if name not in self.filters or len(e.parts) != (2 if name == "default" else 1):
            raise TemplateError(f"there is no filter {name} with {len(e.parts) - 1} arguments")
        return self.filters[name]

    def body(self, nodes: tuple) -> tuple:
        """Nodes with constants folded."""
        out: list = []
        for x in nodes:
            if isinstance(x, Print):
                e = self.fold(x.value)
                x = Text(text_of(e.value)) if isinstance(e, Const) else Print(e)
            elif isinstance(x, Put):
                if x.name in self.constants:
                    raise TemplateError(f"{x.name} is a constant")
                x = Put(x.name, self.fold(x.value))
            elif isinstance(x, Branch):
                test = self.fold(x.test)
                if isinstance(test, Const):
                    taken = self.body(x.then if test.value else x.otherwise)
                    out += taken
                    continue
                x = Branch(test, self.body(x.then), self.body(x.otherwise))
            elif isinstance(x, Marked | Loop):
                x = Marked(self.body(x.body)) if isinstance(x, Marked) else Loop(x.name, self.body(x.body))
            out.append(x)
        merged: list = []
        for x in out:
            if isinstance(x, Text) and merged and isinstance(merged[-1], Text):
                merged[-1] = Text(merged[-1].text + x.text)
            elif x != Text(""):
                merged.append(x)
        return tuple(merged)

    def value(self, e: Any, known: set[str]) -> Callable[[dict], Any]:
        if isinstance(e, Const):
            value = e.value
            return lambda scope: value
        if isinstance(e, Name):
            if e.name not in known:
                raise TemplateError(f"there is no name {e.name}")
            name = e.name
            return lambda scope: scope.get(name)
        parts = [self.value(x, known) for x in e.parts]
        if e.what == "and":
            return lambda scope, a=parts[0], b=parts[1]: a(scope) and b(scope)
        if e.what == "or":
            return lambda scope, a=parts[0], b=parts[1]: a(scope) or b(scope)
        if e.what == "pick":
            return lambda scope, c=parts[0], a=parts[1], b=parts[2]: a(scope) if c(scope) else b(scope)
        f = self.function(e)
        if len(parts) == 1:
            return lambda scope, a=parts[0]: f(a(scope))
        return lambda scope, a=parts[0], b=parts[1]: f(a(scope), b(scope))

    def run(self, body: tuple, known: set[str]) -> Callable[[dict, Out], None]:
        steps: list[Callable[[dict, Out], None]] = []
        for x in body:
            steps.append(self.step(x, known))
            known = self.names((x,), known)

        def every(scope: dict, out: Out) -> None:
            for step in steps:
                step(scope, out)

        return steps[0] if len(steps) == 1 else every

    def step(self, x: Any, known: set[str]) -> Callable[[dict, Out], None]:
        if isinstance(x, Text):
            return lambda scope, out, s=x.text: out.write(s)
        if isinstance(x, Print):
            return lambda scope, out, f=self.value(x.value, known): out.write(text_of(f(scope)))
        if isinstance(x, Put):
            return lambda scope, out, f=self.value(x.value, known), name=x.name: scope.__setitem__(name, f(scope))
        if isinstance(x, Branch):
            test, then, otherwise = self.value(x.test, known), self.run(x.then, known), self.run(x.otherwise, known)
            return lambda scope, out: then(scope, out) if test(scope) else otherwise(scope, out)
        if isinstance(x, Marked):
            inner = self.run(x.body, known)

            def marked(scope: dict, out: Out) -> None:
                start = out.size
                inner(scope, out)
                out.spans.append((start, out.size))

            return marked
        raise TemplateError("the one loop is that over messages, at the top level")

    def stream(self, messages: Iterable[dict], part_chars: int = 1 << 20) -> Iterator[Part]:
        """The output in parts, cut after a message once there are so many characters; spans are counted in their part."""
        scope: dict = {}
        out, coming, i, before = Out(), iter(messages), 0, None
        self._before(scope, out)
        here = next(coming, None)
        while here is not None:
            after = next(coming, None)
            loop = {"index": i + 1, "index0": i, "first": i == 0, "last": after is None, "previtem": before, "nextitem": after}
            self._body(scope | {self._name: here, "loop": loop}, out)
            out.turns += 1
            if after is not None and out.size >= part_chars:
                yield Part("".join(out.texts), out.spans, out.turns, False)
                out = Out()
            before, here, i = here, after, i + 1
        self._after(scope, out)
        yield Part("".join(out.texts), out.spans, out.turns, True)

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The whole output and its spans."""
        (part,) = self.stream(messages, part_chars=1 << 62)
        return part.text, part.spans
