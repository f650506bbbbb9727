"""Tokens of TypeScript, JavaScript and JSX."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield".split()
)
_BEFORE_EXPRESSION = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_IDENT = re.compile(r"#?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
_NUM = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?n?")
_SPACE = re.compile(r"[\s﻿]+")


@dataclass(slots=True)
class Token:
    kind: str  # ident num str template regex punct text
    text: str
    line: int
    end_line: int
    jsx: str = ""  # open, close or attr for names inside tags
    inner: list | None = None  # templates: the tokens of their ${...}


class Lexer:
    def __init__(self, source: str, jsx: bool):
        self.s, self.jsx, self.at, self.line = source, jsx, 0, 1
        self.comments: list[tuple[str, int, int]] = []

    def tokens(self) -> list[Token]:
        out: list[Token] = []
        self.code(out, None)
        return out

    def _move(self, to: int) -> None:
        self.line += self.s.count("\n", self.at, to)
        self.at = to

    def _starts_expression(self, out: list[Token], base: int) -> bool:
        if len(out) <= base:
            return True
        last = out[-1]
        if last.kind == "punct":
            return last.text not in (")", "]", "}", "++", "--") or last.text == "}" and self.jsx is not None and last.jsx != "value"
        return last.kind == "ident" and last.text in _BEFORE_EXPRESSION

    def code(self, out: list[Token], until: str | None) -> None:
        """Tokens until an unmatched ``until`` (not consumed) or the end."""
        base, depth = len(out), 0
        s = self.s
        while self.at < len(s):
            if m := _SPACE.match(s, self.at):
                self._move(m.end())
                continue
            c = s[self.at]
            if s.startswith("//", self.at) or s.startswith("#!", self.at) and self.at == 0:
                end = s.find("\n", self.at)
                end = len(s) if end < 0 else end
                self.comments.append((s[self.at : end], self.line, self.line))
                self._move(end)
                continue
            if s.startswith("/*", self.at):
                end = s.find("*/", self.at + 2)
                end = len(s) if end < 0 else end + 2
                first = self.line
                body = s[self.at : end]
                self._move(end)
                self.comments.append((body, first, self.line))
                continue
            if until and c == until and not depth:
                return
            if c in "\"'":
                out.append(self.string(c))
                continue
            if c == "`":
                out.append(self.template())
                continue
            if c == "/" and self._starts_expression(out, base) and (m := re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(s, self.at)):
                out.append(Token("regex", m[0], self.line, self.line))
                self._move(m.end())
                continue
            if c == "<" and self.jsx and self._starts_expression(out, base) and re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>]))(?!\s*extends\b)").match(s, self.at) and not re.compile(r"<[A-Za-z_$][\w$]*\s*(?:,|extends\b)|<[A-Za-z_$][\w$]*>\s*\(").match(s, self.at):
                self.element(out)
                continue
            if c.isdigit() or c == "." and s[self.at + 1 : self.at + 2].isdigit():
                m = _NUM.match(s, self.at)
                if m and m.end() > self.at:
                    out.append(Token("num", m[0], self.line, self.line))
                    self._move(m.end())
                    continue
            if m := _IDENT.match(s, self.at):
                out.append(Token("ident", m[0], self.line, self.line))
                self._move(m.end())
                continue
            if m := _PUNCT.match(s, self.at):
                if until == "}" and m[0] in "{}":
                    depth += 1 if m[0] == "{" else -1
                out.append(Token("punct", m[0], self.line, self.line))
                self._move(m.end())
                continue
            self._move(self.at + 1)

    def string(self, quote: str) -> Token:
        m = re.compile(quote + r"(?:[^\\\n" + quote + r"]|\\[\s\S])*" + quote + "?").match(self.s, self.at)
        t = Token("str", m[0], self.line, self.line)
        self._move(m.end())
        t.end_line = self.line
        return t

    def template(self) -> Token:
        first, start = self.line, self.at
        inner: list[Token] = []
        self._move(self.at + 1)
        while self.at < len(self.s):
            c = self.s[self.at]
            if c == "\\":
                self._move(min(self.at + 2, len(self.s)))
            elif c == "`":
                self._move(self.at + 1)
                break
            elif self.s.startswith("${", self.at):
                self._move(self.at + 2)
                part: list[Token] = []
                self.code(part, "}")
                inner += [*part, Token("punct", ";", self.line, self.line)]
                self._move(min(self.at + 1, len(self.s)))
            else:
                self._move(self.at + 1)
        return Token("template", self.s[start : self.at], first, self.line, inner=inner)

    def element(self, out: list[Token]) -> None:
        """One JSX element with its children."""
        s = self.s
        out.append(Token("punct", "<", self.line, self.line, jsx="tag"))
        self._move(self.at + 1)
        m = re.compile(r"[A-Za-z_$][\w$.:-]*").match(s, self.at)
        if m:
            out.append(Token("ident", m[0], self.line, self.line, jsx="open"))
            self._move(m.end())
        while self.at < len(s):
            if m := _SPACE.match(s, self.at):
                self._move(m.end())
            elif s.startswith("/*", self.at):
                end = s.find("*/", self.at)
                self._move(len(s) if end < 0 else end + 2)
            elif s.startswith("/>", self.at):
                out.append(Token("punct", "/>", self.line, self.line, jsx="value"))
                self._move(self.at + 2)
                return
            elif s[self.at] == ">":
                out.append(Token("punct", ">", self.line, self.line, jsx="tag"))
                self._move(self.at + 1)
                break
            elif s[self.at] in "\"'":
                end = s.find(s[self.at], self.at + 1)
                end = len(s) if end < 0 else end + 1
                out.append(Token("str", s[self.at : end], self.line, self.line, jsx="value"))
                self._move(end)
            elif s[self.at] == "{":
                self.hole(out)
            elif m := re.compile(r"[A-Za-z_$][\w$:-]*").match(s, self.at):
                out.append(Token("ident", m[0], self.line, self.line, jsx="attr"))
                self._move(m.end())
            else:
                out.append(Token("punct", s[self.at], self.line, self.line, jsx="tag"))
                self._move(self.at + 1)
        while self.at < len(s):  # children
            if s.startswith("</", self.at):
                end = s.find(">", self.at)
                end = len(s) if end < 0 else end + 1
                out.append(Token("punct", s[self.at : end], self.line, self.line, jsx="value"))
                self._move(end)
                return
            if s[self.at] == "{":
                self.hole(out)
            elif s[self.at] == "<":
                self.element(out)
            else:
                m = re.compile(r"[^<{]+").match(s, self.at)
                if m[0].strip():
                    out.append(Token("text", m[0].strip(), self.line, self.line))
                self._move(m.end())

    def hole(self, out: list[Token]) -> None:
        out.append(Token("punct", "{", self.line, self.line, jsx="hole"))
        self._move(self.at + 1)
        self.code(out, "}")
        if self.at < len(self.s):
            out.append(Token("punct", "}", self.line, self.line, jsx="value"))
            self._move(self.at + 1)
