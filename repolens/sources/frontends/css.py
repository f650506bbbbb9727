"""CSS front-end: custom properties, their uses, class selectors."""

from __future__ import annotations

import re

from repolens.sources.frontends.common import Facts

_PIECE = re.compile(r"/\*.*?(?:\*/|$)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]|(?P<var>var\(\s*(?P<use>--[\w-]+))|(?P<decl>--[\w-]+)(?=\s*:)|(?P<cls>\.-?[A-Za-z_][\w-]*)|[^\s\"'{};/.\-v]+|.", re.DOTALL)


def extract_css(text: str) -> dict:
    f = Facts(text)
    depth_rule = [False]  # is the block at hand one of declarations
    for m in _PIECE.finditer(text):
        piece, line = m[0], text.count("\n", 0, m.start()) + 1
        if piece.startswith("/*"):
            f.comment(piece, line, line + piece.count("\n"))
        elif piece == "{":
            head = re.split(r"[{};]", text[: m.start()])[-1]
            depth_rule.append(not re.search(r"@(media|supports|layer|container|keyframes|scope)\b", head))
        elif piece == "}":
            if len(depth_rule) > 1:
                depth_rule.pop()
        elif m["use"]:
            f.css_var_refs.append(m["use"])
        elif m["decl"]:
            f.css_tokens.append({"name": m["decl"], "start_line": line, "end_line": line})
        elif m["cls"] and (not depth_rule[-1] or _nested_selector(text, m.end())):
            f.css_classes.append({"name": piece[1:], "start_line": line, "end_line": line})
    return f.done()


def _nested_selector(text: str, at: int) -> bool:
    """Inside a block of declarations a class is a selector if a block opens before the declaration would end."""
    m = re.compile(r"[{;}]").search(text, at)
    return bool(m) and m[0] == "{"


def css_tokens(text: str) -> list[tuple[str, str, int, bool]]:
    out = []
    for m in re.finditer(r"/\*.*?(?:\*/|$)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?-?[A-Za-z_][\w-]*|\d[\w.%]*|\S", text, re.DOTALL):
        piece = m[0]
        if not piece.startswith("/*"):
            kind = "str" if piece[0] in "\"'" else "num" if piece[0].isdigit() else "ident" if re.match(r"-?-?[A-Za-z_]", piece) else "punct"
            out.append((piece, kind, text.count("\n", 0, m.start()) + 1, piece in (";", "}")))
    return out
