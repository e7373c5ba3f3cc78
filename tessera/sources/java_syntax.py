"""One Java file to its declarations and calls: a pushdown pass over the tokens, with any depth of brackets, types and nested bodies.

`parse` is the small helper that `java_model` runs inside tasks, one file at a time; names, ids, edges and everything across rows are made
of its rows by Spark. Bodies wait on a stack of their own, so depth costs no recursion. A file in which a bracket is open, a declaration is
no declaration, a statement lacks its end or an operator its operand gives one error row in place of all others.
"""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/)
      |(?P<text>\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      |(?P<number>(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[fFdDlL]?)
      |(?P<word>[^\W\d][\w$]*|\$[\w$]*)
      |(?P<sign>->|::|\.\.\.|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<=?|[-+*/%&|^=!<>?:~@.,;()\[\]{}])
      |(?P<other>[\s\S])""",
    re.VERBOSE,
)
# The language's words.
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "transient", "volatile", "sealed"}
PRIMITIVES = {"boolean", "byte", "short", "int", "long", "char", "float", "double", "void"}
NO_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "throw", "super", "this", "assert", "case", "else", "do"}
KEYWORDS = NO_CALLS | PRIMITIVES | MODIFIERS - {"sealed"} | {"new", "class", "interface", "enum", "extends", "implements", "throws", "instanceof", "break", "continue", "goto", "const", "finally", "import", "package"}
SOFT = {"when", "yield", "record", "sealed", "permits", "var"}
#: signs that need an operand after them
BINARY = {"=", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "&&", "||", "/", "%", "^", "|", "*", "+", "-", "->", "!", "~"}
CLOSING = {")": "(", "]": "[", "}": "{"}


class Broken(ValueError):
    """The text is no Java; the argument is the place."""


class File:
    def __init__(self, text: str) -> None:
        self.text = text
        found = [(m.lastgroup, m.group(), m.start()) for m in TOKEN.finditer(text) if m.lastgroup != "skip"]
        self.kind, self.token, self.at = ([t[k] for t in found] for k in range(3))
        self.n = len(found)
        for sentinel in ("", "", ""):
            self.kind.append("end")
            self.token.append(sentinel)
            self.at.append(len(text))
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.match = self.brackets()
        self.rows: list[dict] = []
        self.waiting: list[tuple] = []

    # --- places ---

    def place(self, at: int) -> tuple[int, int]:
        """Line from 1 and column in bytes from 0."""
        lo, hi = 0, len(self.lines)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.lines[mid] <= at else (lo, mid)
        return lo + 1, len(self.text[self.lines[lo] : at].encode("utf-8", "replace"))

    def slice(self, lo: int, hi: int) -> str:
        """The source from token lo up to and without token hi."""
        return self.text[self.at[lo] : self.at[hi - 1] + len(self.token[hi - 1])] if hi > lo else ""

    def brackets(self) -> list[int]:
        match, open_at = [-1] * (self.n + 3), []
        for i in range(self.n):
            t = self.token[i]
            if self.kind[i] == "other":
                raise Broken(self.at[i])
            if self.kind[i] != "sign":
                continue
            if t in "([{":
                open_at.append(i)
            elif t in CLOSING:
                if not open_at or self.token[open_at[-1]] != CLOSING[t]:
                    raise Broken(self.at[i])
                j = open_at.pop()
                match[i], match[j] = j, i
        if open_at:
            raise Broken(self.at[open_at[-1]])
        return match

    # --- pieces of grammar: each takes a place and gives the place behind, or raises ---

    def expect(self, i: int, token: str) -> int:
        if self.token[i] != token:
            raise Broken(self.at[i])
        return i + 1

    def name(self, i: int) -> int:
        if self.kind[i] != "word" or self.token[i] in KEYWORDS:
            raise Broken(self.at[i])
        return i + 1

    def dotted(self, i: int) -> int:
        i = self.name(i)
        while self.token[i] == "." and self.kind[i + 1] == "word":
            i = self.name(i + 1)
        return i

    def annotation(self, i: int, frame: dict, own: list | None = None) -> int:
        """One annotation, noted at everything that is open around it."""
        end = self.dotted(self.expect(i, "@"))
        if self.token[end] == "(":
            end = self.match[end] + 1
        raw = self.slice(i, end)
        if own is not None:
            own.append(raw)
        for row in frame["open"]:
            row["inside"].add(raw)
        return end

    def marks(self, i: int, frame: dict, own: list) -> int:
        """Annotations and modifiers."""
        while True:
            t = self.token[i]
            if t == "@" and self.token[i + 1] != "interface":
                i = self.annotation(i, frame, own)
            elif t == "non" and self.token[i + 1] == "-" and self.token[i + 2] == "sealed":
                i += 3
            elif t in MODIFIERS and self.kind[i] == "word" and not (t == "default" and self.token[i + 1] in (":", "->")) and not (t == "sealed" and self.token[i + 1] in ("=", ".", "(", ";", ",", "[")):
                i += 1
            else:
                return i

    def angles(self, i: int, frame: dict) -> int:
        """Type arguments or parameters of any depth."""
        depth = 0
        while True:
            t = self.token[i]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif t == "@":
                i = self.annotation(i, frame) - 1
            elif not (t in (".", ",", "?", "&", "[", "]", "extends", "super") or t in PRIMITIVES or (self.kind[i] == "word" and t not in KEYWORDS)):
                raise Broken(self.at[i])
            i += 1

    def type(self, i: int, frame: dict) -> int:
        while self.token[i] == "@":
            i = self.annotation(i, frame)
        if self.token[i] in PRIMITIVES:
            i += 1
        else:
            while True:
                i = self.name(i)
                if self.token[i] == "<":
                    i = self.angles(i, frame)
                if self.token[i] != "." or self.token[i + 1] == "..":
                    break
                i += 1
                while self.token[i] == "@":
                    i = self.annotation(i, frame)
        return self.dims(i, frame)

    def dims(self, i: int, frame: dict) -> int:
        while self.token[i] == "[" and self.token[i + 1] == "]":
            i += 2
        return i

    def types(self, i: int, frame: dict, split: str = ",") -> int:
        i = self.type(i, frame)
        while self.token[i] == split:
            i = self.type(i + 1, frame)
        return i

    def type_texts(self, lo: int, hi: int) -> list[str]:
        """Every type that a list of types names, with and without its arguments and scope; sorted, each once."""
        out, starts, start, i = set(), [], None, lo
        while i < hi:
            t = self.token[i]
            if t == "@":
                i = self.dotted(i + 1)
                i = self.match[i] + 1 if self.token[i] == "(" else i
                continue
            if t == "<":
                starts.append(start)
                start = None
            elif t == ">":
                start = starts.pop()
                out.add(self.slice(start, i + 1))
            elif self.kind[i] == "word" and t not in KEYWORDS:
                out.add(t)
                start = i if start is None or self.token[i - 1] != "." else start
                out.add(self.slice(start, i + 1))
            elif t != ".":
                start = None
            i += 1
        return sorted(out)

    def bare(self, lo: int, hi: int) -> str:
        """Types without arguments, annotations and space."""
        out, depth, i = "", 0, lo
        while i < hi:
            t = self.token[i]
            if t == "@":
                i = self.dotted(i + 1)
                i = self.match[i] + 1 if self.token[i] == "(" else i
                continue
            depth += (t == "<") - (t == ">")
            out += t if not depth and t != ">" else ""
            i += 1
        return out

    # --- rows ---

    def row(self, kind: str, i: int, frame: dict, **more: object) -> dict:
        line, column = self.place(self.at[i])
        found = {"node": len(self.rows), "kind": kind, "parent": frame["class"], "class_line": frame["class_line"], "top": frame["top"], "loose": frame["loose"], "callers": frame["callers"], "line": line, "column": column, "inside": set(), **more}
        self.rows.append(found)
        return found

    def end(self, row: dict, last: int) -> None:
        row["end_line"] = self.place(self.at[last] + len(self.token[last]) - 1)[0]

    def parse(self) -> list[dict]:
        frame = {"class": None, "class_line": None, "top": None, "loose": False, "callers": [], "open": [], "owner": None}
        i = 0
        while i < self.n:
            if self.token[i] == ";":
                i += 1
                continue
            own: list[str] = []
            begin = i
            i = self.marks(i, frame, own)
            if self.token[i] == "package":
                end = self.dotted(i + 1)
                self.row("package", begin, frame, name=self.slice(i + 1, end))
                i = self.expect(end, ";")
            elif self.token[i] == "import":
                static = self.token[i + 1] == "static"
                first = i + 1 + static
                end = self.dotted(first)
                if self.token[end] == "." and self.token[end + 1] == "*":
                    end += 2
                self.row("import", begin, frame, name=self.slice(first, end), type="static" if static else None)
                i = self.expect(end, ";")
            elif self.is_type(i):
                i = self.declared(begin, i, frame, own)
            elif self.token[i] in ("module", "open") and self.token[end := self.dotted(i + 1 + (self.token[i] == "open"))] == "{":
                i = self.match[end] + 1  # a module's description declares nothing
            else:
                raise Broken(self.at[i])
        while self.waiting:
            task, *arguments = self.waiting.pop()
            task(*arguments)
        return self.rows

    def is_type(self, i: int) -> bool:
        t = self.token[i]
        return t in ("class", "interface", "enum") or (t == "@" and self.token[i + 1] == "interface") or (t == "record" and self.kind[i + 1] == "word" and self.token[i + 2] in ("(", "<"))

    def declared(self, begin: int, i: int, frame: dict, own: list[str]) -> int:
        """A type's head; its body waits. Gives the place behind the body."""
        kind = "annotation" if self.token[i] == "@" else self.token[i]
        at = i + 1 + (kind == "annotation")
        i = self.name(at)
        row = self.row(kind, begin, frame, name=self.token[at], annotations=own, owner=frame["owner"])
        row["inside"].update(own)
        inner = {**frame, "open": [*frame["open"], row]}
        if self.token[i] == "<":
            i = self.angles(i, inner)
        if kind == "record":
            self.expect(i, "(")
            self.parameters(i, inner)
            i = self.match[i] + 1
        supers: list[str] = []
        for word in ("extends", "implements", "permits"):
            if self.token[i] == word:
                first = i + 1
                i = self.types(first, inner)
                if word == "extends" and kind == "class":
                    row["extends"] = self.type_texts(first, i)[0]
                elif word == "implements":
                    row["interfaces"] = self.type_texts(first, i)
                if word != "permits":
                    supers.append(self.bare(first, i))
        # without their arguments: what a class extends, and what it implements or an interface extends
        row["bare"] = supers[0] if row.get("extends") else None
        row["supers"] = [x for part in supers[1 if row["bare"] else 0 :] for x in part.split(",")]
        self.expect(i, "{")
        close = self.match[i]
        self.end(row, close)
        scope = {**inner, "owner": f"{frame['owner']}.{row['name']}" if frame["owner"] else row["name"]}
        if kind != "annotation":  # an annotation's own members are of no class
            scope |= {"class": row["node"], "class_line": row["line"]}
            scope["top"] = row["node"] if frame["top"] is None else frame["top"]
        else:
            scope["owner"] = frame["owner"]
        self.waiting.append((self.constants if kind == "enum" else self.members, i + 1, close, scope, kind))
        return close + 1

    def constants(self, i: int, close: int, frame: dict, kind: str) -> None:
        while i < close and self.token[i] != ";":
            if self.token[i] == ",":
                i += 1
                continue
            i = self.name(self.marks(i, frame, []))
            if self.token[i] == "(":
                self.waiting.append((self.scan, i + 1, self.match[i], frame))
                i = self.match[i] + 1
            if self.token[i] == "{":
                self.waiting.append((self.members, i + 1, self.match[i], frame, "class"))
                i = self.match[i] + 1
            if i < close and self.token[i] not in (",", ";"):
                raise Broken(self.at[i])
        if i < close:
            self.members(i + 1, close, frame, kind)

    def members(self, i: int, close: int, frame: dict, kind: str) -> None:
        while i < close:
            if self.token[i] == ";":
                i += 1
                continue
            if self.token[i] == "{" or (self.token[i] == "static" and self.token[i + 1] == "{"):
                i += self.token[i] == "static"
                self.waiting.append((self.scan, i + 1, self.match[i], frame))
                i = self.match[i] + 1
                continue
            own: list[str] = []
            begin = i
            i = self.marks(i, frame, own)
            i = self.declared(begin, i, frame, own) if self.is_type(i) else self.member(begin, i, frame, own, kind)
        if i != close:
            raise Broken(self.at[close])

    def member(self, begin: int, i: int, frame: dict, own: list[str], kind: str) -> int:
        shadow: dict = {"inside": set(own)}
        inner = {**frame, "open": [*frame["open"], shadow]}
        if self.token[i] == "<":
            i = self.angles(i, inner)
            while self.token[i] == "@":
                i = self.annotation(i, inner, own)
        type_text = bare = None
        if self.kind[i] == "word" and self.token[i + 1] == "(":
            head = "constructor"
        elif self.kind[i] == "word" and self.token[i + 1] == "{" and kind == "record":
            head = "compact"
        else:
            first = i
            i = self.type(i, inner)
            type_text, bare, head = self.slice(first, i), self.bare(first, i), "method" if self.token[i + 1] == "(" else "field"
        if head == "field":
            return self.field(begin, i, type_text, inner, shadow, own, kind)
        at = i
        i = self.name(i)
        parameters: list[dict] = []
        if head != "compact":
            parameters = self.parameters(i, inner)
            i = self.dims(self.match[i] + 1, inner)
            if self.token[i] == "throws":
                i = self.types(i + 1, inner)
        row = None
        if kind != "annotation" and head != "compact" and frame["class"] is not None:
            line, column = self.place(self.at[at])
            row = self.row(head, begin, frame, name=self.token[at], type=type_text, bare=bare, annotations=own, parameters=parameters, name_line=line, name_column=column, body="", owner=frame["owner"])
            row["inside"] = shadow["inside"]
            inner["open"][-1] = row
        if self.token[i] == "default" and kind == "annotation":
            while self.token[i] != ";":
                if i >= self.n:
                    raise Broken(self.at[begin])
                i = self.match[i] + 1 if self.token[i] in ("(", "{", "[") else i + 1
        if self.token[i] == "{":
            close = self.match[i]
            inner |= {"loose": True, "callers": [*frame["callers"], row["node"]] if row else frame["callers"]}
            if row:
                row["body"] = self.slice(i, close + 1)
            self.waiting.append((self.scan, i + 1, close, inner))
            i = close
        elif head in ("constructor", "compact"):
            raise Broken(self.at[i])
        else:
            self.expect(i, ";")
        if row:
            self.end(row, i)
        return i + 1

    def field(self, begin: int, i: int, type_text: str | None, inner: dict, shadow: dict, own: list[str], kind: str) -> int:
        names = []
        while True:
            names.append(self.token[i])
            i = self.dims(self.name(i), inner)
            if self.token[i] == "=":
                first, angle = i + 1, 0
                while self.token[i] != ";" and not (self.token[i] == "," and angle <= 0):
                    if i >= self.n or self.token[i] == "}":
                        raise Broken(self.at[begin])
                    # a comma between type arguments ends no declarator
                    angle += (self.token[i] == "<" and self.generic(i)) - (self.token[i] == ">" and angle > 0)
                    i = self.match[i] + 1 if self.token[i] in ("(", "{", "[") else i + 1
                if i == first:
                    raise Broken(self.at[i])
                self.waiting.append((self.scan, first, i, {**inner, "loose": True}))
            if self.token[i] != ",":
                break
            i += 1
        self.expect(i, ";")
        if kind in ("class", "enum", "record") and inner["class"] is not None:
            for name in sorted(set(names)):
                row = self.row("field", begin, inner, name=name, type=type_text, annotations=own, owner=inner["owner"])
                row["inside"] = shadow["inside"]
                self.end(row, i)
        return i + 1

    def generic(self, i: int) -> bool:
        """Whether a < opens type arguments, as it does after a name of a type and before a list of types."""
        try:
            end = self.angles(i, {"open": []})
        except Broken:
            return False
        return self.token[end] in ("(", ")", "::", ".", "[", "{") or self.kind[end] == "word"

    def parameters(self, i: int, frame: dict) -> list[dict]:
        out, close = [], self.match[i]
        i += 1
        while i < close:
            own: list[str] = []
            begin = i
            i = self.marks(i, frame, own)
            first = i
            i = self.type(i, frame)
            type_text, bare = self.slice(first, i), self.bare(first, i)
            while self.token[i] == "@":
                i = self.annotation(i, frame, own)
            spread = self.token[i] == "..."
            i += spread
            if self.token[i] == "this" or (self.token[i + 1] == "." and self.token[i + 2] == "this"):
                i += 1 if self.token[i] == "this" else 3  # the receiver is no parameter
            else:
                name = self.token[i]
                i = self.dims(self.name(i), frame)
                out.append({"name": name, "type": type_text, "bare": bare, "spread": spread, "line": self.place(self.at[begin])[0], "annotations": sorted(set(own))})
            if i < close:
                i = self.expect(i, ",")
                if i == close:
                    raise Broken(self.at[i])
        return out

    # --- bodies ---

    def scan(self, i: int, close: int, frame: dict) -> None:
        """Statements and expressions: calls, annotations, local and anonymous classes; what is out of order raises."""
        bodies: set[int] = set()
        arrays: list[bool] = []  # of the braces that are open: whether they hold values
        run = 0
        while i < close:
            t, kind = self.token[i], self.kind[i]
            after = self.token[i + 1] if i + 1 < close else "}"
            if t == "@" and after != "interface":
                end = self.annotation(i, frame)
                self.row("mark", i, frame, name=self.slice(i, end))
                i, run = end, 0
                continue
            if (self.is_type(i) or t in ("abstract", "final", "static", "sealed")) and self.token[i - 1] not in (".", "::"):
                first = self.marks(i, frame, own := [])
                if self.is_type(first) and (kind == "word" or t == "@"):
                    i, run = self.declared(i, first, frame, own), 0
                    continue
            if t == "new" and self.token[i - 1] != "::":
                i, run = self.created(i + 1, frame, bodies), 0
                continue
            if kind == "word" and t not in KEYWORDS:
                run += 1
                if run > 2 and not {t, self.token[i - 1], self.token[i - 2]} & SOFT:
                    raise Broken(self.at[i])
                if after == "(":
                    self.call(i, frame)
            else:
                run = 0
                if kind in ("text", "number"):
                    if self.kind[i + 1] in ("text", "number") and i + 1 < close or (self.kind[i + 1] == "word" and i + 1 < close and self.token[i + 1] not in ("instanceof", "when")):
                        raise Broken(self.at[i + 1])
                elif t in BINARY and (after in (")", "]", "}", ";", ",") or i + 1 >= close):
                    raise Broken(self.at[i])
                elif t == "." and not (self.kind[i + 1] == "word" or after in ("<", "@")):
                    raise Broken(self.at[i])
                elif t == "{":
                    if i in bodies:
                        self.waiting.append((self.members, i + 1, self.match[i], {**frame, "loose": True}, "class"))
                        i = self.match[i] + 1
                        continue
                    before = self.token[i - 1]
                    arrays.append(before in ("=", "]") or (bool(arrays) and arrays[-1] and before in ("{", ",")))
                elif t == "}":
                    values = arrays.pop() if arrays else False
                    if not values and self.token[i - 1] not in (";", "}", "{", ":") and not (self.token[i - 1] == "->"):
                        raise Broken(self.at[i])
            i += 1
        if close < self.n and self.token[close] == "}" and i == close and self.token[close - 1] not in (";", "}", "{", ":"):
            raise Broken(self.at[close])

    def created(self, i: int, frame: dict, bodies: set[int]) -> int:
        """The type behind `new`; the braces behind its arguments are a class body."""
        while self.token[i] == "@":
            i = self.annotation(i, frame)
        if self.token[i] == "<":
            i = self.angles(i, frame)
        first = i
        if self.token[i] in PRIMITIVES:
            return i + 1
        while True:
            i = self.name(i)
            if self.token[i] == "<":
                i = i + 2 if self.token[i + 1] == ">" else self.angles(i, frame)
            if self.token[i] != ".":
                break
            i += 1
        if self.token[i] not in ("(", "[", "{", "@"):
            raise Broken(self.at[first])
        if self.token[i] == "(" and self.token[self.match[i] + 1] == "{":
            bodies.add(self.match[i] + 1)
        return i

    def call(self, i: int, frame: dict) -> None:
        close = self.match[i + 1]
        first = self.chain(i)
        literal = next((self.token[k] for k in range(first, close) if self.kind[k] == "text" and self.token[k][0] == '"'), None)
        line, column = self.place(self.at[i])
        receiver = self.token[i - 2] if self.token[i - 1] == "." and self.kind[i - 2] == "word" else None
        self.row("call", i, frame, name=self.token[i], line=line, column=column, receiver=receiver, expression=self.slice(first, close + 1), literal=literal and literal.strip('"'))

    def chain(self, i: int) -> int:
        """Where the expression begins whose last part is called at i."""
        while True:
            if self.token[i - 1] == ">":  # type arguments of the call
                depth, j = 0, i - 1
                while j > 0:
                    depth += (self.token[j] == ">") - (self.token[j] == "<")
                    j -= 1
                    if not depth:
                        break
                if self.token[j] == ".":
                    i = j + 1
            if self.token[i - 1] != ".":
                break
            j = i - 2
            while self.token[j] in (")", "]"):
                j = self.match[j] - 1
                if self.token[j] in (")", "]"):
                    continue
                if self.kind[j] != "word" or self.token[j] in KEYWORDS - {"this", "super"}:
                    return j + 1
                break
            i = j
        while self.token[i - 1] == "new" or (self.token[i - 1] == "." and self.kind[i - 2] == "word"):
            i -= 1 if self.token[i - 1] == "new" else 2
        return i


def parse(text: str) -> list[dict]:
    """The rows of a file in the order of their places, numbered by `node`; one row of kind "error" where it is broken."""
    try:
        file = File(text)
        rows = file.parse()
    except (Broken, IndexError) as error:
        at = error.args[0] if isinstance(error, Broken) else len(text)
        return [{"node": 0, "kind": "error", "parent": None, "top": None, "class_line": None, "loose": False, "callers": [], "line": text.count("\n", 0, at) + 1, "column": 0, "inside": set()}]
    return rows
