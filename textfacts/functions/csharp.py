"""An approximate lexer for C#: declarations and brace-matched bodies, without binding of names.

Strings (plain, verbatim, raw, interpolated), characters, comments and preprocessor lines are blanked
first, so that braces and keywords in them don't count.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_SKIP = re.compile(
    r"""//[^\n]*
    |/\*.*?(?:\*/|\Z)
    |\$*(?P<q>"{3,}).*?(?P=q)(?!")
    |(?:\$@|@\$?)"(?:[^"]|"")*(?:"|\Z)
    |\$"(?:\\.|\{\{|\}\}|\{(?:[^{}"\n]|"(?:\\.|[^"\\\n])*")*\}|[^"\\\n{}])*"
    |"(?:\\.|[^"\\\n])*"
    |'(?:\\[^\n']+|\\'|[^'\\\n])'
    |^[ \t]*\#[^\n]*""",
    re.DOTALL | re.MULTILINE | re.VERBOSE,
)
_NOT_BREAK = re.compile(r"[^\r\n]")
_USING = re.compile(r"^\s*(?:global\s+)?using\s+[^;(]+$")
_NAMESPACE = re.compile(r"\bnamespace\s+([\w.]+)\s*$")
_TYPE = re.compile(r"\b(class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(@?\w+)")
_OPERATOR = re.compile(r"(?<!\w)operator\s*\S+?\Z")
_VALUE = re.compile(r"(@?\w+)\s*$")
_ATTRIBUTES = re.compile(r"^\s*(?:\[(?:[^\[\]]|\[[^\[\]]*\])*\]\s*)+")
_ACCESSOR = re.compile(r"((?:\b(?:public|protected|internal|private|readonly)\s+)*\b(?:get|set|init|add|remove))\b\s*(?=\{|=>|;)")
_SPACE = re.compile(r"\s+")
_BRACES, _MARKS = re.compile(r"[{}]"), re.compile(r"[{};]")
_ASSIGNED, _SET, _EQUALS = re.compile(r"(?<![=!<>])=(?![=>])"), re.compile(r"(?<![=!<>])=(?!=)"), re.compile(r"(?<![=!<>])=")
_THIS, _FIRST_VALUE, _TO_END = re.compile(r"\bthis\s*\["), re.compile(r"\s*=[^;]*;"), re.compile(r"(?s)\s*=(?!=|>).*$")

TYPES = ("class", "interface", "struct", "enum", "record")


class Declaration(NamedTuple):
    ord: int
    parent: int  #: ord of the enclosing declaration, -1 at the top
    depth: int
    kind: str
    name: str
    n_params: int
    start: int  #: of the header, in characters
    body: int  #: where the body starts, or `end` without one
    end: int
    header: str


def _blank(text: str) -> str:
    return _NOT_BREAK.sub(" ", text) if "\n" in text or "\r" in text else " " * len(text)


def blanked(text: str) -> str:
    """The text, as long as before, with spaces for what is no code."""
    return _SKIP.sub(lambda m: _blank(m[0]), text)


def _without_attributes(head: str) -> str:
    return _ATTRIBUTES.sub("", head) if "[" in head else head


def closing(code: str, at: int) -> int:
    """The place after the brace that closes the one at `at`, or the end."""
    depth = 0
    for m in _BRACES.finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


class Callable(NamedTuple):
    before: str  #: what stands in front of the name
    name: str
    args: str  #: from behind the parenthesis on


def callable_of(head: str) -> Callable | None:
    """What a header calls its first parenthesis' parameters those of. Looked for backwards from there, so in linear time."""
    at = head.find("(")
    before = head[:at].rstrip() if at >= 0 else ""
    if "=" in before and not _OPERATOR.search(before):
        return None
    if before.endswith(">") and "<" in before and not _OPERATOR.search(before):  # type parameters
        depth, i = 0, len(before)
        while i and (depth or i == len(before)):
            i -= 1
            depth += (before[i] == ">") - (before[i] == "<")
        before = before[:i].rstrip()
    end = len(before)
    start = end
    while start and (before[start - 1].isalnum() or before[start - 1] == "_"):
        start -= 1
    while start and before[start - 1] in "@~":
        start -= 1
    if start == end:
        found = _OPERATOR.search(before)
        if not found:
            return None
        start = found.start()
    elif found := re.search(r"(?<!\w)operator\s+\Z", before[max(0, start - 64) : start]):
        start -= len(found[0])
    return Callable(before[:start], before[start:], head[at + 1 :])


def parameters(args: str) -> int:
    """How many parameters stand before the parenthesis that closes the list."""
    depth, n, some = 1, 0, False
    for c in args:
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
            if not depth:
                break
        elif c == "," and depth == 1:
            n += 1
        some = some or not c.isspace()
    return n + 1 if some else 0


def declarations(text: str | None) -> list[Declaration]:
    """Usings, namespaces, types and their direct members in order of place. Bodies of members aren't looked into."""
    return _declarations(blanked(text or ""))


def _declarations(code: str) -> list[Declaration]:
    out: list[Declaration] = []
    open_: list[tuple[int, str, str]] = []  # ord, kind and name of the declarations around
    start, at = 0, 0

    def add(kind: str, name: str, params: int, first: int, body: int, end: int) -> None:
        head = _without_attributes(code[first:body] if body > first else code[first:end])
        head = _TO_END.sub("", head) if kind == "field" and "=" in head else head
        out.append(Declaration(len(out), open_[-1][0] if open_ else -1, len(open_), kind, name, params, first, body, end, " ".join(head.split()).strip(" ;{")))

    while m := _MARKS.search(code, at):
        i, mark = m.start(), m[0]
        raw = code[start:i]
        first = start + len(raw) - len(raw.lstrip())
        head = _without_attributes(raw).strip()
        inside = open_[-1] if open_ else None
        in_type = inside is not None and inside[1] in TYPES
        at = i + 1
        if mark == "}":
            if open_:
                n = open_.pop()[0]
                out[n] = out[n]._replace(end=at)
            start = at
            continue
        if mark == ";":
            start = at
            if "namespace" in head and (found := _NAMESPACE.search(head)):  # of the whole file
                add("namespace", found[1], 0, first, i, at)
                open_.append((len(out) - 1, "namespace", found[1]))
            elif not in_type:
                if (found := _TYPE.search(head)) and not _USING.match(head):
                    add(found[1].split()[0], found[2], 0, first, at, at)
                elif _USING.match(head):
                    add("using", head.split("using", 1)[1].strip(), 0, first, at, at)
            elif head and not head.startswith("="):
                arrow = head.find("=>")
                before = head if arrow < 0 else head[:arrow]
                body = at if arrow < 0 else start - 1 - len(raw) + raw.find("=>")
                if (found := callable_of(before)) and not _TYPE.search(found.before):
                    add("ctor" if found.name == inside[2] else "method", found.name, parameters(found.args), first, body, at)
                elif arrow >= 0 and not _ASSIGNED.search(before):
                    add("property", (_VALUE.search(before) or [None, "this"])[1], 0, first, body, at)
                elif found := _TYPE.search(before):
                    add(found[1].split()[0], found[2], 0, first, at, at)
                else:
                    name = _VALUE.search(_ASSIGNED.split(before)[0].split(",")[0])
                    add("field", name[1] if name else "", 0, first, at, at)
            continue
        if "namespace" in head and (found := _NAMESPACE.search(head)):
            add("namespace", found[1], 0, first, i, len(code))
            open_.append((len(out) - 1, "namespace", found[1]))
            start = at
        elif (found := _TYPE.search(head)) and "(" not in head[: found.start()]:
            kind = found[1].split()[0]
            add(kind, found[2], 0, first, i, len(code))
            if kind == "enum":
                start = at = closing(code, i)
                out[-1] = out[-1]._replace(end=at)
            else:
                open_.append((len(out) - 1, kind, found[2]))
                start = at
        elif in_type and not _EQUALS.search(head.split("(", 1)[0]) and (found := callable_of(head)):
            end = closing(code, i)
            add("ctor" if found.name == inside[2] else "method", found.name, parameters(found.args), first, i, end)
            start = at = end
        elif in_type and head and not _SET.search(head):
            end = closing(code, i)
            name = _THIS.search(head)
            add("property", "this" if name else (_VALUE.search(head) or [None, ""])[1], 0, first, i, end)
            start = at = end
            if later := _FIRST_VALUE.match(code, end):  # a property's first value
                start = at = later.end()
        else:  # an initialiser, or code outside of types
            at = closing(code, i)
            start = start if in_type else at
    return out


def accessors(body: str) -> str:
    """A property's accessors without what they do."""
    code, found, at = blanked(body), [], 1
    while m := _ACCESSOR.search(code, at):
        found.append(_SPACE.sub(" ", m[1]) + ";")
        at = closing(code, m.end()) if code[m.end() : m.end() + 1] == "{" else max(m.end(), code.find(";", m.end()))
    return "{ " + " ".join(found) + " }" if found else "{ }"


def without_bodies(text: str | None) -> str | None:
    """The source with empty bodies and accessors as stubs. Text without declarations stays as it is."""
    if text is None:
        return None
    out, at = [], 0
    for d in declarations(text):
        if d.kind in ("method", "ctor", "property") and d.body < d.end:
            arrow = text[d.body] != "{"
            stub = (" { get; }" if arrow else accessors(text[d.body : d.end])) if d.kind == "property" else (" { }" if arrow else "{ }")
            out += [text[at : d.body].rstrip() if arrow else text[at : d.body], stub]
            at = d.end
    return "".join(out) + text[at:]


def outline(text: str | None) -> str | None:
    """Headers of usings, namespaces, types and members, a line each, indented by depth."""
    if text is None:
        return None
    return "\n".join("    " * d.depth + (f"using {d.name};" if d.kind == "using" else d.header) for d in declarations(text))


def problems(text: str | None, most: int | None = None) -> list[str]:
    """Brackets that close nothing, close another kind or stay open, in order of the text, each with its line; the first `most` of them."""
    if not text:
        return []
    code, open_, out = blanked(text), [], []
    pairs = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] not in pairs:
            open_.append((m[0], m.start()))
        elif open_ and open_[-1][0] == pairs[m[0]]:
            open_.pop()
        else:
            out.append((m.start(), f"unexpected {m[0]}"))
    out += [(at, f"{mark} is not closed") for mark, at in open_]
    told, line, last = [], 1, 0
    for at, what in sorted(out)[:most]:
        line, last = line + code.count("\n", last, at), at
        told.append(f"line {line}: {what}")
    return told


# Occurrences of names.

#: Reserved words of C#, which name nothing.
RESERVED = frozenset(
    """abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event
    explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null
    object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string
    struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while""".split()
)
#: Reserved words that are types.
BUILT_IN = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort".split())
_NO_TYPE = (RESERVED - BUILT_IN) | frozenset("await yield record where when and or not".split())
_NAME = re.compile(r"@?(?<![\w])[^\W\d]\w*+")
_LOCAL = re.compile(r"(?<![\w.])(?P<type>[^\W\d][\w.]*+)(?:<[^<>;(){}]*(?:<[^<>;(){}]*>[^<>;(){}]*)*>)?(?:\[\])?\??[ \t\r\n]+(?P<name>@?[^\W\d]\w*+)\s*(?=[,)=;]|in\b)(?!=[=>])")
_MADE = re.compile(r"\s*=\s*new\s+([\w.]+)")
_MADE_BEFORE = re.compile(r"\bnew\s+([\w.]+)\s*(?:<[^()]*>)?\s*\Z")
_FIELD = re.compile(r"([^\W\d][\w.]*)(?:<.*>)?(?:\[\])?\??\s+@?\w+\s*(?:[=;{].*)?\Z", re.DOTALL)
_BRACKETS = re.compile(r"[()\[\]{},]")
_DOTTED = re.compile(r"[\w.]+")
_LAMBDA = re.compile(r"(?<![\w.])([^\W\d]\w*+)\s*=>")
_CALL = re.compile(r"\s*(?:<(?:[\w\s,.?\[\]]|<[\w\s,.?\[\]]*+>)*+>)?\s*\(")
_CONTEXTS = ("method", "ctor", "property", "field", "class", "interface")


MOST_DOTS = 16


class Declared(NamedTuple):
    """A declaration with where its name stands and what holds it."""

    at: Declaration
    scope: str  #: the names of the namespaces and types around, with dots
    name_start: int
    name_end: int
    context: str  #: how it is shown where something stands within it


class Occurrence(NamedTuple):
    name: str
    start: int
    end: int
    line: int
    role: str  #: declaration, use, or local: a use of a parameter or variable of the member around
    before: str  #: the names or the type in front of the dot before it; "" without a dot, "?" if the type of a value isn't known
    n_args: int | None  #: of a call
    owner: int  #: ord of the declaration that is its context, -1 without one
    scopes: list[str]  #: where its name, with `before`, is looked for: the scopes around, the innermost first, then what is used
    declared: Declared | None


def with_holes(text: str) -> str:
    """As blanked(), but what stands in the holes of interpolated strings stays."""
    return _both(text)[1]


def _both(text: str) -> tuple[str, str]:
    """blanked() and with_holes() in one pass."""
    plain: list[str] = []
    holed: list[str] = []
    at = 0
    for m in _SKIP.finditer(text):
        code, found = text[at : m.start()], m[0]
        blank = _blank(found)
        plain += [code, blank]
        holed += [code, _holes(found) if found.lstrip("@").startswith("$") else blank]
        at = m.end()
    return "".join(plain) + text[at:], "".join(holed) + text[at:]


_OPENS = re.compile(r"(?<!\{)\{(?!\{)")


def _holes(quoted: str) -> str:
    width = max(1, len(quoted) - len(quoted.lstrip("$"))) if quoted.startswith("$") else 1
    out, at = [], 0
    opens = _OPENS if width == 1 else re.compile(r"(?<!\{)\{{%d}(?!\{)" % width)
    while m := opens.search(quoted, at):
        depth, i, cut = 0, m.end(), None
        while i < len(quoted) and not (quoted[i] == "}" and not depth):
            depth += (quoted[i] in "([{") - (quoted[i] in ")]}")
            if quoted[i] == ":" and not depth and cut is None:  # a format follows
                cut = i
            i += 1
        end = i if cut is None else cut
        out += [_blank(quoted[at : m.end()]), blanked(quoted[m.end() : end])]
        at = end
    return "".join(out) + _blank(quoted[at:])


#: What follows the name in a header.
_AFTER = {"method": re.compile(r"\s*(?:<[^()]*>)?\s*\("), "ctor": re.compile(r"\s*\("), "field": re.compile(r"\s*(?:[=;,]|\Z)"), "property": re.compile(r"\s*(?:\[|\{|=>|\Z)")}


def _place(head: str, name: str, at: int, after: re.Pattern | None) -> int:
    """Where a name stands as a word of its own, followed by a pattern; -1 if nowhere."""
    word = lambda c: c.isalnum() or c == "_"
    while name and (at := head.find(name, at)) >= 0:
        end = at + len(name)
        if not (at and word(head[at - 1])) and not (end < len(head) and word(head[end])) and (after is None or after.match(head, end)):
            return at
        at = end
    return -1


def declared(text: str | None) -> list[Declared]:
    """The declarations of a source but its usings, with scopes and the places of their names."""
    code = blanked(text or "")
    return _declared(text or "", code, _declarations(code))


def _declared(text: str, code: str, found: list[Declaration]) -> list[Declared]:
    out = []
    full: dict[int, str] = {-1: ""}
    for d in found:
        scope = full.get(d.parent, "")
        full[d.ord] = f"{scope}.{d.name}".lstrip(".")
        if d.kind == "using":
            continue
        head_end = d.body if d.start < d.body < d.end else d.end
        head = code[d.start : head_end]
        first = d.start + (m.end() if "[" in head and (m := _ATTRIBUTES.match(head)) else 0)
        head = code[first:head_end]
        at = _place(head, d.name, max(0, head.find(d.kind)) if d.kind in TYPES else 0, _AFTER.get(d.kind))
        start = d.start if at < 0 else first + at
        shown = d.header
        if d.kind in ("method", "ctor"):
            shown = (re.split(r"\s*=>", shown)[0] if "=>" in shown else shown) + ";"
        elif d.kind == "property":
            shown += " " + (accessors(text[d.body : d.end]) if text[d.body : d.body + 1] == "{" else "{ get; }")
        elif d.kind == "field":
            shown = " ".join(text[first : d.end].split())
        elif d.kind in ("class", "interface"):
            shown = f"{d.kind} {d.name}"
        out.append(Declared(d, scope, start, start if at < 0 else start + len(d.name), shown))
    return out


def _locals(code: str, d: Declaration) -> dict[str, str]:
    """Parameters and variables of a member, each with its type's name, or "?" where it isn't told."""
    found: dict[str, str] = {}
    for m in _LAMBDA.finditer(code, d.body, d.end):
        found[m[1]] = "?"
    for m in _LOCAL.finditer(code, d.start, d.end):
        if m["type"] not in _NO_TYPE and m["name"] not in RESERVED:
            kind = m["type"] if m["type"] not in ("var", "dynamic") else "?"
            if kind == "?" and (made := _MADE.match(code, m.end("name"))):
                kind = made[1]
            found[m["name"].lstrip("@")] = kind
    return found


_GENERIC = re.compile(r"<[\w\s,.?\[\]]*>")


def _brackets(code: str) -> tuple[dict[int, int], dict[int, int]]:
    """Of each closed parenthesis where it opens, and of each that opens how many arguments it holds, in one pass."""
    code = _GENERIC.sub(lambda m: " " * len(m[0]), code) if "<" in code else code
    opened: dict[int, int] = {}
    held: dict[int, int] = {}
    stack: list[list[int]] = []  # place, commas, whether anything stands there
    last = 0
    for m in _BRACKETS.finditer(code):
        c, i = m[0], m.start()
        if stack and not stack[-1][2] and i > last and not code[last:i].isspace():
            stack[-1][2] = 1
        last = i + 1
        if c in ")]}":
            if stack:
                at, commas, some = stack.pop()
                opened[i] = at
                held[at] = commas + 1 if some else 0
            continue
        if stack:
            stack[-1][2] = 1
            stack[-1][1] += c == ","
        if c in "([{":
            stack.append([i, 0, 0])
    if stack and code[last:].strip():
        stack[-1][2] = 1
    for at, commas, some in stack:
        held[at] = commas + 1 if some else 0
    return opened, held


def _receiver(code: str, dot: int, types: dict[str, str], opened: dict[int, int]) -> str:
    """What stands in front of a dot, by name: types of values that are told, else their names, else "?"; long chains are "?"."""
    names: list[str] = []
    i = dot
    while True:
        if i and code[i - 1] in "?!":
            i -= 1
        if i and code[i - 1] == ")":
            j = opened.get(i - 1, 0)
            made = _MADE_BEFORE.search(code[max(0, j - 200) : j])
            return made[1] if made and not names else "?"
        j = i
        while j and (code[j - 1].isalnum() or code[j - 1] in "_@"):
            j -= 1
        if j == i or len(names) == MOST_DOTS:
            return "?"
        names.insert(0, code[j:i].lstrip("@"))
        if not (j and code[j - 1] == "."):
            break
        i = j - 1
    if names[0] in ("this", "base"):
        names = names[1:]
        if not names:
            return ""
    if names[0] in types:
        return types[names[0]] if len(names) == 1 else "?"
    return ".".join(names)


def occurrences(text: str | None) -> list[Occurrence]:
    """The names of a source in order of place: those of declarations and all uses, without comments and strings but with the holes of interpolated ones.

    Types of values are told by their declarations in the same member or type, or by `new`; no other binding is done.
    """
    if not text:
        return []
    plain, code = _both(text)
    found = _declarations(plain)
    own = _declared(text, plain, found)
    opened, held = _brackets(code)
    used = [d.name for d in found if d.kind == "using" and _DOTTED.fullmatch(d.name)]
    at_name = {d.name_start: d for d in own if d.name_end > d.name_start}
    fields: dict[int, dict[str, str]] = {}  # of each type the types of its fields and properties
    for d in own:
        if d.at.kind in ("field", "property") and (m := _FIELD.search(d.at.header)):
            fields.setdefault(d.at.parent, {})[d.at.name] = m[1]
    out: list[Occurrence] = []
    open_: list[Declared] = []
    upcoming, line, last = iter(own), 1, 0
    coming = next(upcoming, None)
    known: dict[int, dict[str, str]] = {}
    typed: dict[int, dict[str, str]] = {}

    def place(around: list[Declared], shown: list[Declared]) -> tuple[list[Declared], int, dict[str, str], list[str], int]:
        """What is around, the ord of the innermost, its parameters and variables, the scopes seen and the ord of the context."""
        inner = around[-1] if around else None
        scope, locals_ = "", {}
        if inner:
            scope = f"{inner.scope}.{inner.at.name}".lstrip(".") if inner.at.kind in (*TYPES, "namespace") else inner.scope
            if inner.at.kind in ("method", "ctor", "property"):
                if inner.at.ord not in known:
                    known[inner.at.ord] = _locals(code, inner.at)
                locals_ = known[inner.at.ord]
        parts = scope.split(".") if scope else []
        scopes = [".".join(parts[:n]) for n in range(len(parts), 0, -1)] + used + [""]
        context = next((d for kind in _CONTEXTS for d in reversed(shown) if d.at.kind == kind and not d.at.name.startswith("~")), None)
        return around, inner.at.ord if inner else -1, locals_, scopes, context.at.ord if context else -1

    now, until = None, 0  # of uses, as long as nothing opens or closes
    for m in _NAME.finditer(code):
        word, start, end = m[0], m.start(), m.end()
        if word in RESERVED or (start and code[start - 1] == "#"):
            continue
        name = word.lstrip("@")
        while coming and coming.at.start <= start:
            open_.append(coming)
            coming = next(upcoming, None)
            now, until = None, min(until, open_[-1].at.end) if len(open_) > 1 else open_[-1].at.end
        if open_ and until <= start:
            open_ = [d for d in open_ if start < d.at.end]
            now, until = None, min((d.at.end for d in open_), default=0)
        line, last = line + code.count("\n", last, start), start
        here = at_name.get(start) or at_name.get(end - len(name))
        if here:
            around = [d for d in open_ if d is not here]
            got = place(around, [*around, here])
        else:
            got = now = now or place(open_[:], open_)
        around, key, locals_, scopes, context = got
        dot = start
        while dot and code[dot - 1].isspace():
            dot -= 1
        dotted = dot > 0 and code[dot - 1] == "."
        before = ""
        if dotted:
            if key not in typed:
                typed[key] = {n: t for d in around if d.at.kind in TYPES for n, t in fields.get(d.at.ord, {}).items()} | locals_
            before = _receiver(code, dot - 1, typed[key], opened)
        role = "declaration" if here else "local" if not dotted and name in locals_ else "use"
        args = None
        if role == "use" and ((after := code[end : end + 1]) in ("(", "<") or after.isspace()):
            args = _CALL.match(code, end)
        out.append(Occurrence(name, end - len(name), end, line, role, before, held.get(args.end() - 1, 0) if args else None, context, scopes, here))
    return out
