"""TypeScript, TSX and JavaScript front-end: facts from tokens and matched brackets."""

from __future__ import annotations

from repolens.sources.frontends.common import Facts
from repolens.sources.frontends.lexer import KEYWORDS, Lexer, Token

_MODIFIERS = frozenset("public private protected static readonly abstract override async get set declare accessor export default".split())
_LITERAL = frozenset("true false null undefined".split())
_TYPE_WORDS = frozenset("string number boolean any unknown never object symbol bigint".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def unquoted(t: Token) -> str:
    return t.text[1:-1] if len(t.text) > 1 and t.text[-1] == t.text[0] else t.text[1:]


class Script:
    def __init__(self, facts: Facts, tokens: list[Token]):
        self.f, self.t = facts, tokens
        n = len(tokens)
        self.close = [-1] * n  # of an opening bracket its partner, and back
        self.above = [-1] * n  # the bracket that a token stands in
        stack: list[int] = []
        for i, t in enumerate(tokens):
            self.above[i] = stack[-1] if stack else -1
            if t.kind != "punct":
                continue
            if t.text in _PAIRS:
                stack.append(i)
            elif t.text in _PAIRS.values():
                while stack and _PAIRS[tokens[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    self.close[i], self.close[j] = j, i
                    self.above[i] = stack[-1] if stack else -1
        for j in stack:
            self.close[j] = n
        self.names: set[int] = set()  # names that are not references: members, keys
        self.skip: set[int] = set()  # tokens of import statements
        self.functions: list[tuple[int, int, str, int, int, str | None]] = []

    # -- small helpers
    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind in ("punct", "ident") else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "ident" and self.t[i].text not in KEYWORDS

    def line(self, i: int) -> int:
        return self.t[min(max(i, 0), len(self.t) - 1)].line

    def end_line(self, i: int) -> int:
        return self.t[min(max(i, 0), len(self.t) - 1)].end_line

    def statement_end(self, i: int) -> int:
        """Place after the simple statement or declaration at i: at ``;``, or where a line ends and another begins."""
        n = len(self.t)
        while i < n:
            t = self.t[i]
            if t.kind == "punct":
                if t.text == ";":
                    return i + 1
                if t.text in _PAIRS:
                    i = min(self.close[i], n - 1) if self.close[i] >= 0 else i
                elif t.text in (")", "]", "}"):
                    return i
            following = i + 1
            if following < n and self.t[following].line > self.t[i].end_line and self._ends(i) and self._begins(following):
                return following
            i += 1
        return n

    def _ends(self, i: int) -> bool:
        t = self.t[i]
        return t.kind != "punct" or t.text in (")", "]", "}", "++", "--", "/>") or t.text.startswith("</") or t.text == ">" and t.jsx == ""

    def _begins(self, i: int) -> bool:
        t = self.t[i]
        return t.kind not in ("punct",) and t.text not in ("instanceof", "in", "as", "satisfies", "extends", "implements", "from", "else", "catch", "finally") or t.text in ("{", "}", "@", "++", "--", "!", "~")

    def inner_end(self, i: int) -> int:
        """Place after one statement, compound ones with all their parts."""
        n, word = len(self.t), self.text(i)
        if i >= n:
            return n
        if word == "{":
            return min(self.close[i] + 1, n)
        if word in ("if", "while", "for", "with"):
            j = i + 1
            if self.text(j) == "await":
                j += 1
            j = self.inner_end(min(self.close[j] + 1, n) if self.text(j) == "(" else j)
            if word == "if" and self.text(j) == "else":
                j = self.inner_end(j + 1)
            return j
        if word == "do":
            j = self.inner_end(i + 1)
            return self.statement_end(j) if self.text(j) == "while" else j
        if word == "switch":
            j = min(self.close[i + 1] + 1, n) if self.text(i + 1) == "(" else i + 1
            return min(self.close[j] + 1, n) if self.text(j) == "{" else j
        if word == "try":
            j = self.inner_end(i + 1)
            while self.text(j) in ("catch", "finally"):
                j = min(self.close[j + 1] + 1, n) if self.text(j) == "catch" and self.text(j + 1) == "(" else j + 1
                j = self.inner_end(j)
            return j
        if word in ("function", "class") or word == "async" and self.text(i + 1) == "function":
            j = i
            while j < n and self.text(j) != "{":
                j = min(self.close[j] + 1, n) if self.text(j) in ("(", "[") else j + 1
            return min(self.close[j] + 1, n) if j < n else n
        return self.statement_end(i)

    def dotted(self, last: int) -> tuple[str, int]:
        """``a.b.c`` that ends at ``last``, and where it begins; '' where the base is no name."""
        parts, i = [self.t[last].text], last
        while self.text(i - 1) in (".", "?.") and i >= 2:
            before = self.t[i - 2]
            if before.kind != "ident" or before.text in KEYWORDS and before.text not in ("this", "super"):
                return "", i
            parts.append(before.text)
            i -= 2
        return ".".join(reversed(parts)), i

    # -- statements
    def run(self) -> None:
        i = 0
        while i < len(self.t):
            word = self.text(i)
            fresh = self.text(i - 1) not in (".", "?.") and self.t[i].jsx == ""
            if fresh and word == "import" and self.text(i + 1) not in (".", ""):
                self.dynamic_import(i) if self.text(i + 1) == "(" else self.import_statement(i)
            elif fresh and word == "import" and i + 1 < len(self.t) and self.t[i + 1].kind == "str":
                self.import_statement(i)
            elif fresh and word == "export":
                self.export_statement(i)
            elif fresh and word == "function":
                self.function_declaration(i)
            elif fresh and word == "class" and self.is_name(i + 1):
                self.class_declaration(i)
            elif fresh and word in ("interface", "enum") and self.is_name(i + 1) and self.text(i + 2) in ("{", "<", "extends"):
                self.type_declaration(i)
            elif fresh and word == "type" and self.is_name(i + 1) and self.text(i + 2) in ("=", "<") and self.text(i - 1) not in (",", "{"):
                self.type_declaration(i)
            elif fresh and word in ("const", "let", "var") and self.text(i + 1) != "enum":
                self.variables(i)
            elif word == "=>" and self.t[i].kind == "punct":
                self.arrow(i)
            elif word == "(" and i and self.t[i].kind == "punct":
                self.call(i)
            i += 1
        self.object_members()
        self.references()
        self.complexities()

    def import_statement(self, i: int) -> None:
        end = i + 1
        while end < len(self.t) and self.t[end].kind != "str":
            if self.text(end) in (";",) or end > i + 1 and self.text(end) in ("import", "export", "const", "let", "function"):
                break
            end += 1
        stop = end
        if self.text(end) == ";" or end >= len(self.t) or self.t[end].kind != "str":  # import x = a.b
            stop = end - 1
        is_type = self.text(i + 1) == "type" and self.text(i + 2) not in ("from", ",", "=")
        names: list[tuple[str, str]] = []
        namespace, kind = False, "Static"
        j = i + 1 + is_type
        if self.is_name(j) and self.text(j) != "from":
            if self.text(j + 1) == "=" and self.text(j + 2) == "require":
                names, kind = [("default", self.t[j].text)], "Require"
            else:
                names.append(("default", self.t[j].text))
        while j < end:
            if self.text(j) == "*":
                namespace = True
            elif self.text(j) == "{":
                names += self.specifiers(j)
                j = self.close[j]
            j += 1
        if end < len(self.t) and self.t[end].kind == "str":
            self.f.imported(unquoted(self.t[end]), names, self.line(i), self.end_line(end), kind, namespace, is_type)
        self.skip.update(range(i, stop + 1))

    def specifiers(self, opening: int) -> list[tuple[str, str]]:
        out, j, end = [], opening + 1, self.close[opening]
        while j < end:
            if self.text(j) == "type" and self.text(j + 1) not in (",", "}", "as"):
                j += 1
            if self.t[j].kind in ("ident", "str"):
                name = unquoted(self.t[j]) if self.t[j].kind == "str" else self.t[j].text
                local = name
                if self.text(j + 1) == "as":
                    local = self.t[j + 2].text
                    j += 2
                out.append((name, local))
            j += 1
        return out

    def dynamic_import(self, i: int) -> None:
        end = min(self.close[i + 1], len(self.t) - 1)
        arg = self.t[i + 2] if i + 2 < len(self.t) else None
        if arg and arg.kind == "str":
            self.f.imported(unquoted(arg), [("*", "default")], self.line(i), self.end_line(end), "Dynamic", True)
        else:
            self.f.markers.append({"kind": "UnresolvableDynamicImport", "dotted": None, "on_symbol": None, "value": None})

    def export_statement(self, i: int) -> None:
        f, j = self.f, i + 1
        is_type = self.text(j) == "type" and self.text(j + 1) in ("{", "*")
        j += is_type
        if self.text(j) in ("*", "{"):
            star = self.text(j) == "*"
            end = j + 1 if star else self.close[j] + 1
            alias = self.t[end + 1].text if star and self.text(end) == "as" else None
            end += 2 if alias else 0
            if self.text(end) == "from" and end + 1 < len(self.t) and self.t[end + 1].kind == "str":
                source = unquoted(self.t[end + 1])
                names = [("*", alias or "*")] if star else self.specifiers(j)
                f.imported(source, [] if star else names, self.line(i), self.end_line(end + 1), namespace=star, is_type=is_type, reexport=True)
                for _, local in names:
                    if local != "*":
                        f.export(local, "ReExportNamed", source, is_type, self.line(i), self.end_line(end + 1))
                if star and not alias:
                    f.exports.append({"name": "*", "kind": "ReExportAll", "source": source, "is_type_only": is_type, "start_line": self.line(i), "end_line": self.end_line(end + 1)})
                self.skip.update(range(i, end + 2))
            elif not star:
                for _, local in self.specifiers(j):
                    f.export(local, is_type=is_type, first=self.line(i), last=self.end_line(end - 1))
            return
        if self.text(j) == "default":
            j += 1
            k = j
            while self.text(k) in ("async", "abstract", "function", "class", "*"):
                k += 1
            # the declared or named thing behind the default, kept as its source
            local = self.t[k].text if self.is_name(k) and (k > j or self.text(k + 1) not in (".", "(", "?.", "=>", "[")) else None
            f.export("default", "Default", local, first=self.line(i), last=self.line(i))
        while self.text(j) in ("async", "abstract", "declare"):
            j += 1
        word = self.text(j)
        if word == "const" and self.text(j + 1) == "enum":
            word, j = "enum", j + 1
        if word in ("const", "let", "var"):
            for k in self.binders(j):
                f.export(self.t[k].text, first=self.line(i), last=self.end_line(k))
        elif word in ("function", "class", "interface", "type", "enum", "namespace"):
            k = j + 2 if self.text(j + 1) == "*" else j + 1
            if self.is_name(k) and self.text(k) != "extends":
                f.export(self.t[k].text, first=self.line(i), last=self.line(k))

    def exported(self, i: int) -> bool:
        while self.text(i - 1) in ("async", "abstract", "declare", "default", "const"):
            i -= 1
        return self.text(i - 1) == "export"

    def binders(self, i: int) -> list[int]:
        """Names bound by the declarators of ``const``, ``let`` or ``var`` at i; patterns bind none here."""
        out, j, n = [], i + 1, len(self.t)
        end = self.statement_end(i + 1)
        while j < end:
            if self.is_name(j):
                out.append(j)
            while j < end and self.text(j) != ",":
                j = min(self.close[j] + 1, n) if self.text(j) in _PAIRS and self.close[j] >= 0 else j + 1
            j += 1
        return out

    def variables(self, i: int) -> None:
        # a loop's binding is one too
        found = self.binders(i)
        end = self.statement_end(i + 1)
        for k in found:
            self.f.symbol(self.t[k].text, "Variable", self.line(k), self.end_line(end - 1) if k == found[-1] else self.end_line(k), self.exported(i))

    def function_declaration(self, i: int) -> None:
        j = i + 2 if self.text(i + 1) == "*" else i + 1
        named = self.is_name(j)
        name = self.t[j].text if named else self.assigned_name(i)
        k = j + 1 if named else j
        if self.text(k) == "<":
            while k < len(self.t) and self.text(k) != "(":
                k += 1
        if self.text(k) != "(":
            return
        body = self.body_after(self.close[k] + 1)
        declaration = named and self.text(i - 1) not in ("=", "(", ",", ":", "return", "?", "=>", "&&", "||")
        first = i - 1 if self.text(i - 1) == "async" else i
        if declaration:
            self.f.symbol(name, "Function", self.line(first), self.end_line(self.close[body]) if body else self.end_line(self.close[k]), self.exported(i))
        if body:
            if declaration:
                self.parameters(k, body, name)
            self.functions.append((body, self.close[body] + 1, name, self.line(first), self.end_line(self.close[body]), None))

    def body_after(self, i: int) -> int | None:
        """The ``{`` of the body that follows a parameter list, past a return type."""
        n = len(self.t)
        if self.text(i) == ":":
            i += 1
            while i < n and self.text(i) not in (";", "}", "=>", ")"):
                if self.text(i) == "{" and self.text(i - 1) not in (":", "|", "&", "<", ",", "is"):
                    return i
                i = self.close[i] + 1 if self.text(i) in _PAIRS and self.close[i] >= 0 else i + 1
            return None
        return i if self.text(i) == "{" and self.close[i] < n else None

    def assigned_name(self, i: int) -> str:
        while self.text(i - 1) == "async":
            i -= 1
        j = i - 1
        if self.text(j) in ("=", ":"):
            k = j - 1
            if self.text(j) == "=" and not self.is_name(k) or self.text(j) == "=" and self.text(k - 1) == ":":
                m = k
                while m > 0 and self.text(m) not in (";", "{", "}", "const", "let", "var") and self.t[m].line == self.t[k].line:
                    if self.text(m) == ":" and self.is_name(m - 1):
                        return self.t[m - 1].text
                    m -= 1
            if self.is_name(k) or self.t[k].kind == "ident":
                return self.t[k].text
        return "(anonymous)"

    def arrow(self, i: int) -> None:
        start = self.close[i - 1] if self.text(i - 1) == ")" and self.close[i - 1] >= 0 else i - 1
        if self.text(i - 1) not in (")",) and not self.is_name(i - 1):  # a return type
            k = i - 1
            while k > 0 and not (self.text(k) == ")" and self.text(k + 1) == ":"):
                if self.text(k) in (";", "{", "="):
                    return
                k = self.close[k] - 1 if self.text(k) in (")", "]", "}") and self.close[k] >= 0 else k - 1
            start = self.close[k]
        elif self.is_name(i - 1) and self.text(i - 2) == ":":
            if self.text(i - 3) != ")":
                return
            start = self.close[i - 3]
        if start < 0:
            return
        body = i + 1
        end = self.close[body] + 1 if self.text(body) == "{" else self.expression_end(body)
        if self.text(body) == ">" or end > len(self.t):
            return
        name = self.assigned_name(start)
        self.functions.append((body, end, name, self.line(start), self.end_line(end - 1), None))

    def expression_end(self, i: int) -> int:
        n = len(self.t)
        while i < n and self.text(i) not in (",", ";", ")", "]", "}"):
            if self.text(i) in _PAIRS and self.close[i] >= 0:
                i = min(self.close[i], n - 1)
            if i + 1 < n and self.t[i + 1].line > self.t[i].end_line and self._ends(i) and self._begins(i + 1):
                return i + 1
            i += 1
        return i

    def parameters(self, opening: int, body: int, name: str | None) -> None:
        """Trailing parameters that the body never names; patterns and rests stop the search."""
        every: list[tuple[str, int, int] | None] = []
        j, end = opening + 1, self.close[opening]
        while j < end:
            k = j
            while k < end and self.text(k) != ",":
                k = self.close[k] + 1 if self.text(k) in _PAIRS and self.close[k] >= 0 else k + 1
                if k < end and self.text(k) == "<":  # generic arguments may hold commas
                    depth = 0
                    while k < end:
                        depth += {"<": 1, ">": -1, ">>": -2}.get(self.text(k), 0)
                        k += 1
                        if depth <= 0:
                            break
            first = j
            while self.text(first) == "@":
                first += 2
                first = self.close[first] + 1 if self.text(first) == "(" else first
            if self.text(first) in _MODIFIERS and self.is_name(first + 1):
                pass  # a property of the class
            elif self.is_name(first):
                every.append((self.t[first].text, self.line(first), self.end_line(k - 1)))
            elif first < end:
                every.append(None)
            j = k + 1
        every = [p for p in every if p is None or p[0] != "this"]
        used = {self.t[x].text for x in range(body, self.close[body]) if self.t[x].kind == "ident" and self.text(x - 1) not in (".", "?.")}
        for t in self.t[body : self.close[body]]:
            used.update(x.text for x in t.inner or ())
        for p in reversed(every):
            if p is None or p[0] in used:
                break
            if not p[0].startswith("_"):
                self.f.symbol(p[0], "Parameter", p[1], p[2], parent=name)

    def type_declaration(self, i: int) -> None:
        word, name, j = self.text(i), self.t[i + 1].text, i + 2
        if word == "type":
            end = self.statement_end(j) - 1
        else:
            while j < len(self.t) and self.text(j) != "{":
                j += 1
            end = min(self.close[j], len(self.t) - 1) if j < len(self.t) else i
        first = i
        while self.text(first - 1) in ("const", "declare"):
            first -= 1
        self.f.symbol(name, "Type", self.line(first), self.end_line(end), self.exported(i), is_type=word != "enum")
        if word == "enum":
            k = j + 1
            while k < end:
                if self.t[k].kind in ("ident", "str"):
                    self.names.add(k)
                    self.f.symbol(unquoted(self.t[k]) if self.t[k].kind == "str" else self.t[k].text, "EnumMember", self.line(k), self.line(k), parent=name)
                while k < end and self.text(k) != ",":
                    k = self.close[k] + 1 if self.text(k) in _PAIRS and self.close[k] >= 0 else k + 1
                k += 1
        elif word == "interface" and j < len(self.t):
            self.keys(j)

    def keys(self, opening: int) -> None:
        """Property names of an interface's body are not references."""
        for k in range(opening + 1, min(self.close[opening], len(self.t))):
            if self.above[k] == opening and self.t[k].kind == "ident" and (self.text(k + 1) in (":", "?", "(") and self.text(k - 1) in ("{", ";", ",", "}", "readonly") or self.t[k].line > self.t[k - 1].line):
                self.names.add(k)

    def class_declaration(self, i: int) -> None:
        name, j, n = self.t[i + 1].text, i + 2, len(self.t)
        while j < n and self.text(j) != "{":
            j = self.close[j] + 1 if self.text(j) == "(" else j + 1
        if j >= n or self.close[j] >= n:
            return
        first = i
        while self.text(first - 1) == "abstract":
            first -= 1
        self.f.symbol(name, "Class", self.line(first), self.end_line(self.close[j]), self.exported(i))
        self.members(j, name)

    def members(self, opening: int, owner: str) -> None:
        k, end = opening + 1, self.close[opening]
        while k < end:
            start, private = k, False
            while self.text(k) == "@":
                k += 2
                while self.text(k) == ".":
                    k += 2
                k = self.close[k] + 1 if self.text(k) == "(" else k
                start = k
            while self.text(k) in _MODIFIERS and self.text(k + 1) not in ("(", "=", ":", ";", "?", "!", "}"):
                private |= self.text(k) == "private"
                k += 1
            k += self.text(k) == "*"
            t = self.t[k] if k < end else None
            if t is None:
                break
            if t.kind not in ("ident", "str") and t.text != "[":
                k = self.close[k] + 1 if t.text in _PAIRS and self.close[k] >= 0 else k + 1
                continue
            at = k
            self.names.add(k)
            k = self.close[k] + 1 if t.text == "[" else k + 1
            while self.text(k) in ("?", "!"):
                k += 1
            if self.text(k) == "<":
                while k < end and self.text(k) != "(":
                    k += 1
            hidden = (private or t.text.startswith("#")) and t.text != "constructor" and t.text != "["
            if self.text(k) == "(":
                body = self.body_after(self.close[k] + 1)
                stop = self.close[body] if body else self.statement_end(self.close[k] + 1) - 1
                if hidden:
                    self.f.symbol(t.text.lstrip("#"), "Method", self.line(start), self.end_line(stop), parent=owner)
                if body:
                    self.parameters(k, body, t.text)
                    self.functions.append((body, self.close[body] + 1, t.text, self.line(start), self.end_line(stop), owner))
                k = stop + 1
            else:
                stop = max(self.statement_end(k) - 1, at)
                if hidden:
                    self.f.symbol(t.text.lstrip("#"), "Field", self.line(start), self.end_line(stop), parent=owner)
                k = stop + 1
            while self.text(k) == ";":
                k += 1

    def call(self, i: int) -> None:
        before = self.t[i - 1]
        if before.kind != "ident" or i - 1 in self.names or before.text in KEYWORDS and before.text not in ("this", "super") or self.text(i - 2) in ("function", "new") or before.jsx:
            return
        name, first = self.dotted(i - 1)
        if not name or self.text(first - 1) in ("new", "function"):
            return
        end = min(self.close[i], len(self.t) - 1)
        if name == "require" and i + 1 < len(self.t) and self.t[i + 1].kind == "str":
            self.f.imported(unquoted(self.t[i + 1]), [("*", "default")], self.line(first), self.end_line(end), "Require", True)
        self.f.calls.append({"callee": name, "start_line": self.line(first), "end_line": self.end_line(end)})

    def object_members(self) -> None:
        """Keys and methods of object literals, and keys of types, are not references."""
        for k, t in enumerate(self.t):
            if t.kind != "ident" or t.jsx:
                continue
            j = self.above[k]
            if j >= 0 and self.text(j) == "{" and self.t[j].jsx == "" and self.text(k - 1) in ("{", ",", ";", "async", "get", "set", "readonly"):
                if self.text(k + 1) == ":" or self.text(k + 1) == "?" and self.text(k + 2) == ":":
                    self.names.add(k)
                elif self.text(k + 1) == "(" and self.close[k + 1] >= 0 and self.text(k - 1) in (",", "{", "async", "get", "set") and (body := self.body_after(self.close[k + 1] + 1)) and t.text not in KEYWORDS and k not in self.names and self.text(j - 1) in ("=", "(", ",", ":", "return", "[", "?", "=>"):
                    self.names.add(k)
                    self.functions.append((body, self.close[body] + 1, t.text, self.line(k), self.end_line(self.close[body]), None))

    def references(self) -> None:
        f = self.f

        def one(i: int, t: Token) -> None:
            if t.kind == "str":
                if t.jsx == "value" and self.text(i - 1) == "=" and self.t[i - 2].text in ("className", "class"):
                    for name in unquoted(t).split():
                        f.css_class_refs.append(name)
                if unquoted(t):
                    f.strings.append(unquoted(t))
            elif t.kind == "template":
                for j, x in enumerate(t.inner):
                    if x.kind == "ident" and x.text not in KEYWORDS:
                        if j and t.inner[j - 1].text in (".", "?."):
                            f.member(x.text)
                        else:
                            f.refs.append(x.text)
                    elif x.kind in ("str", "template"):
                        one(-1, x)
            elif t.kind == "ident" and i not in self.names:
                if t.jsx == "open":
                    f.refs.append(t.text.partition(".")[0])
                elif t.jsx == "attr":
                    return
                elif self.text(i - 1) in (".", "?."):
                    f.member(t.text)
                elif t.text not in KEYWORDS and t.text not in _LITERAL and t.text not in _TYPE_WORDS:
                    f.refs.append(t.text)
                    j = self.above[i]
                    if j >= 0 and self.text(j) == "{" and self.t[j].jsx == "" and self.text(i - 1) in ("{", ",") and self.text(i + 1) in ("}", ",", "="):
                        f.member(t.text)

        for i, t in enumerate(self.t):
            if i not in self.skip:
                one(i, t)

    # -- complexity
    def complexities(self) -> None:
        spans = sorted(self.functions, key=lambda x: (x[1], -x[0]))
        for body, end, name, first, last, owner in spans:
            holes = [(a, b) for a, b, *_ in spans if body < a and b <= end and (a, b) != (body, end)]
            cyclomatic, cognitive = self.score(body, end, 0, holes)
            self.f.functions.append({"name": name, "parent": owner, "start_line": first, "end_line": last, "cyclomatic": 1 + cyclomatic, "cognitive": cognitive, "loc": last - first + 1})

    def score(self, i: int, end: int, nesting: int, holes: list[tuple[int, int]]) -> tuple[int, int]:
        """(decisions, cognitive weight) of the tokens in [i, end) outside inner functions."""
        outer = {a: b for a, b in holes}
        c = g = 0

        def inside(a: int, b: int, deeper: int) -> None:
            nonlocal c, g
            x, y = self.score(a, b, deeper, [h for h in holes if a <= h[0] and h[1] <= b])
            c, g = c + x, g + y

        while i < end:
            if i in outer and outer[i] > i:
                i = outer[i]
                continue
            word, free = self.text(i), self.text(i - 1) not in (".", "?.") and i not in self.names
            if word in ("if", "for", "while", "catch", "switch", "do") and free and self.t[i].kind == "ident":
                c, g = c + (word != "switch"), g + 1 + nesting
                if word == "if":
                    then = self.inner_end(self.close[i + 1] + 1) if self.text(i + 1) == "(" else i + 1
                    inside(i + 1, min(then, end), nesting + 1)
                    i = max(then, i + 1)
                    if self.text(i) == "else":
                        g += 1
                        stop = min(self.inner_end(i + 1), end)
                        inside(i + 1, stop, nesting + 1)
                        i = max(stop, i + 1)
                    continue
                if word == "catch":
                    j = self.close[i + 1] + 1 if self.text(i + 1) == "(" else i + 1
                    stop = self.inner_end(j)
                else:
                    stop = self.inner_end(i)
                stop = min(max(stop, i + 1), end)
                inside(i + 1, stop, nesting + 1)
                i = stop
                continue
            if word == "case" and free and self.t[i].kind == "ident":
                c += 1
            elif word in ("&&", "||", "??"):
                c, g = c + 1, g + 1
            elif word == "?" and self.text(i + 1) not in (":", ",", ")", "=", ";", ".") and self.text(i - 1) != "-":
                c, g = c + 1, g + 1 + nesting
                stop = min(self.expression_end(i + 1), end)
                if stop > i + 1:
                    inside(i + 1, stop, nesting + 1)
                    i = stop
                    continue
            i += 1
        return c, g


def extract_script(text: str, language: str | None = "TypeScript") -> dict:
    f = Facts(text)
    lexer = Lexer(text, language in ("Tsx", "JavaScript"))
    tokens = lexer.tokens()
    for body, first, last in lexer.comments:
        f.comment(body, first, last)
    Script(f, tokens).run()
    return f.done()


def script_tokens(text: str, language: str | None) -> list[tuple[str, str, int, bool]]:
    """(text, kind, line, statement end) of each token; strings and templates are one token."""
    kinds = {"num": "num", "str": "str", "template": "str", "regex": "str", "text": "punct", "punct": "punct"}
    out = []
    for t in Lexer(text, language in ("Tsx", "JavaScript")).tokens():
        kind = kinds.get(t.kind) or ("punct" if t.text in KEYWORDS else "ident")
        out.append((t.text, kind, t.line, t.text in (";", "}") and t.kind == "punct"))
    return out
