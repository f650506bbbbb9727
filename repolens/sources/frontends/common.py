"""What the front-ends share: the fact record, comment tags, language and role of a path."""

from __future__ import annotations

import re

# Extensions by language.
LANGUAGES = {"ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "Tsx", "jsx": "Tsx", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "pyi": "Python", "css": "Css"}
SCRIPT_EXTENSIONS = ("ts", "mts", "cts", "tsx", "jsx", "js", "mjs", "cjs")
VISIBILITY = {"@public": "Public", "@internal": "Internal", "@expected-unused": "ExpectedUnused"}


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rpartition("/")[2].rpartition(".")[2]) if "." in path.rpartition("/")[2] else None


def role_of(path: str) -> str:
    """Source, Config, TypeDecl or PackageInit."""
    name = path.rpartition("/")[2].lower()
    if name == "__init__.py":
        return "PackageInit"
    if name.endswith(".pyi") or re.search(r"\.d\.[mc]?ts$", name):
        return "TypeDecl"
    stem, _, extension = name.rpartition(".")
    if extension in SCRIPT_EXTENSIONS and (stem.endswith(".config") or stem.startswith(".") and stem.endswith("rc")):
        return "Config"
    return "Source"


def suppression(comment: str, line: int) -> dict | None:
    """``<tool>-ignore-file RULE -- reason`` or ``<tool>-ignore-next-line RULE -- reason``; a rule is required."""
    m = re.match(r"[a-z]+-ignore-(file|next-line)\s+(\S+)(.*)", comment.lstrip("/#* ").rstrip("*/ "), re.DOTALL)
    if not m or m[2].startswith("--"):
        return None
    _, dashes, reason = m[3].partition("--")
    return {"rule": m[2], "file_scoped": m[1] == "file", "line": line if m[1] == "file" else line + 1, "reason": reason.strip() if dashes else None}


def annotation(comment: str, below: int) -> dict | None:
    """A visibility tag that opens a line of the comment; it belongs to the declaration on the line below."""
    for raw in comment.splitlines():
        tag, _, rest = raw.strip().lstrip("/*# ").strip().partition(" ")
        if tag in VISIBILITY:
            _, dashes, reason = rest.partition("--")
            return {"visibility": VISIBILITY[tag], "line": below, "reason": (reason.strip() or None) if dashes else None}
    return None


class Facts:
    """Collects one file's facts."""

    LISTS = ("symbols", "imports", "exports", "refs", "member_access", "markers", "suppressions", "annotations", "strings", "functions", "calls", "css_tokens", "css_var_refs", "css_classes", "css_class_refs")

    def __init__(self, text: str):
        for name in self.LISTS:
            setattr(self, name, [])
        self.loc = len(text.splitlines())

    def comment(self, text: str, first: int, last: int) -> None:
        if found := suppression(text, first):
            self.suppressions.append(found)
        if found := annotation(text, last + 1):
            self.annotations.append(found)

    def symbol(self, name: str, kind: str, first: int, last: int, exported: bool = False, parent: str | None = None, is_type: bool = False) -> None:
        self.symbols.append({"name": name, "kind": kind, "start_line": first, "end_line": last, "exported": exported, "is_type_only": is_type, "parent": parent, "visibility": None})

    def export(self, name: str, kind: str = "Named", source: str | None = None, is_type: bool = False, first: int = 1, last: int = 1) -> None:
        self.exports.append({"name": name, "kind": kind, "source": source, "is_type_only": is_type, "start_line": first, "end_line": last})

    def imported(self, specifier: str, names: list[tuple[str, str]], first: int, last: int, kind: str = "Static", namespace: bool = False, is_type: bool = False, reexport: bool = False) -> None:
        self.imports.append({"specifier": specifier, "kind": kind, "is_namespace": namespace, "is_type_only": is_type, "is_reexport": reexport, "start_line": first, "end_line": last, "names": [{"imported": a, "local": b} for a, b in names]})

    def member(self, name: str) -> None:
        if name := name.lstrip("#"):
            self.member_access.append(name)

    def done(self) -> dict:
        """Exported names reach their symbols, tags the first untagged symbol on their line."""
        exported = {e["name"] for e in self.exports}
        for s in self.symbols:
            s["exported"] = s["exported"] or s["name"] in exported
        for a in self.annotations:
            for s in self.symbols:
                if s["start_line"] == a["line"] and s["visibility"] is None:
                    s["visibility"] = a["visibility"]
                    break
        return {name: getattr(self, name) for name in self.LISTS} | {"loc": self.loc}
