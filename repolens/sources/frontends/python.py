"""Python front-end over ``ast`` and ``tokenize``; broken files fall back to their tokens."""

from __future__ import annotations

import ast
import io
import keyword
import re
import token as T
import tokenize

from repolens.sources.frontends.common import Facts

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _tokens(text: str) -> list[tokenize.TokenInfo]:
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            out.append(t)
    except (tokenize.TokenError, SyntaxError):  # what came before the error still counts
        pass
    return out


def dotted(node: ast.expr) -> str:
    """``a.b.c``, or '' where the base is no name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def _identifiers(nodes: list[ast.AST]) -> set[str]:
    found = set()
    for top in nodes:
        for n in ast.walk(top):
            if isinstance(n, ast.Name):
                found.add(n.id)
            elif isinstance(n, ast.Attribute):
                found.add(n.attr)
            elif isinstance(n, ast.arg):
                found.add(n.arg)
            elif isinstance(n, ast.keyword) and n.arg:
                found.add(n.arg)
            elif isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
                found.add(n.name)
    return found


class _Visitor:
    def __init__(self, facts: Facts):
        self.f = facts

    def module(self, tree: ast.Module) -> None:
        for node in tree.body:
            self.visit(node, 0)

    def visit(self, node: ast.AST, depth: int) -> None:
        f = self.f
        if isinstance(node, ast.Import):
            for a in node.names:
                f.imported(a.name, [("*", a.asname or a.name.split(".")[0])], node.lineno, node.end_lineno, namespace=True)
            return
        if isinstance(node, ast.ImportFrom):
            names = [(a.name, a.asname or a.name) for a in node.names if a.name != "*"]
            f.imported("." * node.level + (node.module or "") or ".", names, node.lineno, node.end_lineno, namespace=len(names) < len(node.names))
            return
        inner = depth
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            f.refs.append(node.name)
            for d in node.decorator_list:
                name = dotted(d.func if isinstance(d, ast.Call) else d)
                if name:
                    f.markers.append({"kind": "Decorator", "dotted": name, "on_symbol": node.name if d is node.decorator_list[-1] else None, "value": None})
            if not depth:
                f.symbol(node.name, "Class" if is_class else "Function", node.lineno, node.end_lineno, not node.name.startswith("_") or node.name.startswith("__") and node.name.endswith("__"))
                if is_class:
                    self.private_methods(node)
                elif not node.decorator_list:
                    self.parameters(node)
            inner = depth + 1
        elif isinstance(node, ast.Name):
            f.refs.append(node.id)
        elif isinstance(node, ast.arg):
            f.refs.append(node.arg)
        elif isinstance(node, ast.keyword) and node.arg:
            f.refs.append(node.arg)
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            f.refs += node.names
        elif isinstance(node, ast.Attribute):
            f.refs.append(node.attr)
            f.member(node.attr)
        elif isinstance(node, ast.Call):
            if name := dotted(node.func):
                f.calls.append({"callee": name, "start_line": node.lineno, "end_line": node.end_lineno})
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value:
            f.strings.append(node.value)
            if re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)+", node.value):
                f.markers.append({"kind": "ModuleStringLiteral", "dotted": None, "on_symbol": None, "value": node.value})
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and not depth:
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name) and t.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                    for e in node.value.elts:
                        if isinstance(e, ast.Constant) and isinstance(e.value, str):
                            f.export(e.value, first=node.lineno, last=node.end_lineno)
        for child in ast.iter_child_nodes(node):
            self.visit(child, inner)

    def parameters(self, node: ast.FunctionDef) -> None:
        """Trailing parameters that the body never names; splats stop the search."""
        a = node.args
        every: list[ast.arg | None] = [*a.posonlyargs, *a.args]
        every += [None] if a.vararg else []
        every += a.kwonlyargs
        every += [None] if a.kwarg else []
        if every and every[0] is not None and every[0].arg in ("self", "cls"):
            every = every[1:]
        used = _identifiers(node.body)
        for p in reversed(every):
            if p is None or p.arg in used:
                break
            if not p.arg.startswith("_"):
                self.f.symbol(p.arg, "Parameter", p.lineno, p.end_lineno, parent=node.name)

    def private_methods(self, node: ast.ClassDef) -> None:
        for m in node.body:
            if isinstance(m, _FUNCTIONS) and m.name.startswith("_") and not m.name.endswith("__") and not m.decorator_list:
                self.f.symbol(m.name, "Method", m.lineno, m.end_lineno, parent=node.name)


def functions(tree: ast.Module) -> list[dict]:
    """Complexity of each function, inner ones apart and before the outer."""
    out: list[dict] = []

    def walk(node: ast.AST, frame: list[int] | None, nesting: int, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            enter(child, frame, nesting, owner, node)

    def add(frame: list[int] | None, cyclomatic: int, cognitive: int) -> None:
        if frame is not None:
            frame[0] += cyclomatic
            frame[1] += cognitive

    def enter(node: ast.AST, frame: list[int] | None, nesting: int, owner: str | None, above: ast.AST) -> None:
        if isinstance(node, (*_FUNCTIONS, ast.Lambda)):
            own = [1, 0]
            name = getattr(node, "name", None)
            if name is None:
                target = above.targets[0] if isinstance(above, ast.Assign) else None
                name = target.id if isinstance(target, ast.Name) else "(anonymous)"
            walk(node, own, 0, owner)
            out.append({"name": name, "parent": owner, "start_line": node.lineno, "end_line": node.end_lineno, "cyclomatic": own[0], "cognitive": own[1], "loc": node.end_lineno - node.lineno + 1})
        elif isinstance(node, ast.ClassDef):
            walk(node, frame, nesting, node.name)
        elif isinstance(node, ast.If):
            chain(node, frame, nesting, owner)
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            add(frame, 1, 1 + nesting)
            for child in ast.iter_child_nodes(node):
                enter(child, frame, nesting + 1, owner, node)
            add(frame, 0, 1 if node.orelse else 0)
        elif isinstance(node, (ast.ExceptHandler, ast.IfExp)):
            add(frame, 1, 1 + nesting)
            walk(node, frame, nesting + 1, owner)
        elif isinstance(node, ast.Match):
            add(frame, 0, 1 + nesting)
            walk(node, frame, nesting + 1, owner)
        elif isinstance(node, ast.match_case):
            add(frame, 1, 0)
            walk(node, frame, nesting, owner)
        elif isinstance(node, ast.BoolOp):
            add(frame, len(node.values) - 1, len(node.values) - 1)
            walk(node, frame, nesting, owner)
        else:
            walk(node, frame, nesting, owner)

    def chain(node: ast.If, frame: list[int] | None, nesting: int, owner: str | None) -> None:
        add(frame, 1, 1 + nesting)
        while True:
            for child in [node.test, *node.body]:
                enter(child, frame, nesting + 1, owner, node)
            rest = node.orelse
            if len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == node.col_offset:  # elif
                add(frame, 1, 1)
                node = rest[0]
                continue
            add(frame, 0, 1 if rest else 0)
            for child in rest:
                enter(child, frame, nesting + 1, owner, node)
            return

    walk(tree, None, 0, None)
    return out


def _from_tokens(tokens: list[tokenize.TokenInfo], f: Facts) -> None:
    """Imports, names and strings of a file that does not parse."""
    names = [t for t in tokens if t.type not in (T.NL, T.COMMENT, T.INDENT, T.DEDENT)]
    i = 0
    while i < len(names):
        t = names[i]
        if t.type == T.NAME and t.string in ("import", "from") and (i == 0 or names[i - 1].type == T.NEWLINE):
            end = next((k for k in range(i, len(names)) if names[k].type == T.NEWLINE), len(names))
            line = " ".join(x.string for x in names[i:end])
            try:
                visitor = _Visitor(f)
                for node in ast.parse(line).body:
                    before = len(f.imports)
                    visitor.visit(node, 0)
                    for x in f.imports[before:]:
                        x["start_line"], x["end_line"] = t.start[0], names[end - 1].end[0]
            except SyntaxError:
                pass
            i = end
        elif t.type == T.NAME and not keyword.iskeyword(t.string):
            f.refs.append(t.string)
            if i and names[i - 1].string == ".":
                f.member(t.string)
            if i and names[i - 1].string in ("def", "class") and t.start[1] <= 6:
                f.symbol(t.string, "Class" if names[i - 1].string == "class" else "Function", t.start[0], t.end[0], not t.string.startswith("_"))
        i += 1


def extract_python(text: str) -> dict:
    f = Facts(text)
    tokens = _tokens(text)
    for t in tokens:
        if t.type == T.COMMENT:
            f.comment(t.string, t.start[0], t.end[0])
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        _from_tokens(tokens, f)
        return f.done()
    _Visitor(f).module(tree)
    f.functions = functions(tree)
    return f.done()


def python_tokens(text: str) -> list[tuple[str, str, int, bool]]:
    """(text, kind, line, statement end) of each token; a string with its parts is one token."""
    out, depth = [], 0
    for t in _tokens(text):
        kind = tokenize.tok_name[t.type]
        if kind == "FSTRING_START":
            depth += 1
            if depth == 1:
                out.append((t.string, "str", t.start[0], False))
        elif kind == "FSTRING_END":
            depth -= 1
        elif depth or t.type in (T.COMMENT, T.NL, T.NEWLINE, T.INDENT, T.DEDENT, T.ENDMARKER):
            continue
        elif t.type == T.NAME:
            out.append((t.string, "punct" if keyword.iskeyword(t.string) else "ident", t.start[0], False))
        elif t.type == T.NUMBER:
            out.append((t.string, "num", t.start[0], False))
        elif t.type == T.STRING:
            out.append((t.string, "str", t.start[0], False))
        else:
            out.append((t.string, "punct", t.start[0], t.string in (";", "}")))
    return out
