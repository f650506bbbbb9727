"""URL filters (operator 10): pattern rules indexed by their rarest literal token.

Rules are host/path prefixes with a verdict, or patterns with ``*``, ``^`` and ``||``. A rule's literal tokens are runs of
letters and digits: whole where the rule bounds them on both sides, else the begin, end or middle of a URL's token
(``*/banner*`` holds the begin ``banner``). Each rule is filed under that of its tokens which is rarest in the corpus;
a URL's tokens, and those of their begins, ends and middles that have the length of a filed piece, fetch candidate
rules, and only candidates are matched. A pattern without a letter or digit cannot be filed and is refused.
Host and path rules decide first (the longest wins); the patterns decide what they leave open; what no pattern blocks
is allowed.

Defined results: a null url or one without ``://`` has an empty host and path, fits no host rule and is judged
by the patterns over its whole text (null: allowed). Very long urls are judged whole. Repeated rows give a row each;
empty tables give none; extra columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production rules: (verdict, host/path prefix).
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Production patterns. ``||``: at a host label's start; ``^``: a separator or the end; ``*``: anything.
PATTERNS = (
    "||ads-track.*", "||doubleclick.net^", "/adserver/*", "/banner*/ad", "||tracker.*/collect^", "*/click?*redirect=", "/phishing/*", "||adnetwork.*", "||adserving.*", "||popads.*", "||clickbank.*^", "/pagead/*",
    "*/popunder*", "*popup-ad*", "/doorway/*", "/adframe.", "-adbanner-", "*&affiliate_id=", "/track/click^", "*/malware-*", "/redirect.php?url=", "*utm_campaign=spam", "/exit-intent^", "||casino-*.", "*/warez/",
)

_TOKEN = re.compile(r"[a-z0-9]+")
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


#: How a URL's token holds it (whole, begin, end, middle), and the literal.
Piece = tuple[str, str]


class Pieces:
    """Finds which of some pieces a text's tokens hold."""

    def __init__(self, pieces: set[Piece]):
        self.whole = {x for kind, x in pieces if kind == "whole"}
        self.parts = {k: {x for kind, x in pieces if kind == k} for k in ("begin", "end", "middle")}
        self.sizes = {k: sorted({len(x) for x in v}) for k, v in self.parts.items()}

    def of(self, text: str) -> set[Piece]:
        found = set()
        for token in set(_TOKEN.findall(text)):
            if token in self.whole:
                found.add(("whole", token))
            n = len(token)
            for size in self.sizes["begin"]:
                if size <= n and token[:size] in self.parts["begin"]:
                    found.add(("begin", token[:size]))
            for size in self.sizes["end"]:
                if size <= n and token[n - size :] in self.parts["end"]:
                    found.add(("end", token[n - size :]))
            for size in self.sizes["middle"]:
                found.update(("middle", token[i : i + size]) for i in range(n - size + 1) if token[i : i + size] in self.parts["middle"])
        return found


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str
    kind: str  # host or pattern

    def matches(self, host: str, path: str, url: str) -> bool:
        if self.kind == "host":
            own, slash, rest = self.text.partition("/")
            return (host == own or host.endswith("." + own)) and path.startswith(slash + rest)
        return bool(self.regex.search(url))

    @property
    def regex(self) -> re.Pattern:
        return _compiled(self.text)

    def tokens(self) -> list[Piece]:
        """Literal tokens that every matching URL holds: whole, or as the begin, end or middle of one of its own."""
        if self.kind == "host":
            return [("whole", x) for x in _TOKEN.findall(self.text.partition("/")[0])]
        found = []
        for part in _TOKEN.finditer(self.text):
            before, after = self.text[: part.start()][-1:], self.text[part.end() :][:1]
            begins, ends = before not in ("", "*"), after not in ("", "*")
            found.append(("whole" if begins and ends else "begin" if begins else "end" if ends else "middle", part[0]))
        return found


_patterns: dict[str, re.Pattern] = {}


def _compiled(text: str) -> re.Pattern:
    if text not in _patterns:
        body, head = text, ""
        if text.startswith("||"):
            body, head = text[2:], r"://(?:[^/?#]*\.)?"
        out = "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body)
        _patterns[text] = re.compile(head + out, re.DOTALL)
    return _patterns[text]


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], seen: dict[Piece, int]):
        self.by_piece: dict[Piece, list[Rule]] = {}
        for rule in rules:
            pieces = rule.tokens()
            if not pieces:
                raise ValueError(f"no literal token in {rule.text!r}")
            self.by_piece.setdefault(min(pieces, key=lambda t: (seen.get(t, 0), -len(t[1]), t)), []).append(rule)
        self.pieces = Pieces(set(self.by_piece))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """Host, path, the deciding host rule's text or None, the verdict."""
        host, path = split_url(url)
        low = (url or "").translate(_LOWER)
        best: Rule | None = None
        blocked = False
        for piece in self.pieces.of(low):
            for rule in self.by_piece[piece]:
                if rule.kind == "host":
                    if (best is None or len(rule.text) > len(best.text)) and rule.matches(host, path, low):
                        best = rule
                elif not blocked:
                    blocked = rule.matches(host, path, low)
        return host, path, best.text if best else None, best.verdict if best else "block" if blocked else "allow"


def pattern_sql(patterns=PATTERNS) -> str:
    """One regular expression of all patterns, for SQL."""
    return "(?s)" + "|".join(_compiled(x).pattern for x in patterns)


def compile_rules(host_rules=HOST_RULES, patterns=PATTERNS) -> list[Rule]:
    return [Rule(v, t, "host") for v, t in host_rules] + [Rule("block", t, "pattern") for t in patterns]


def token_counts(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[Piece, int]:
    """In how many rows each rule token occurs, over all rows. As many counts as the rules have tokens."""
    pieces = Pieces({t for r in rules for t in r.tokens()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                if url:
                    seen.update(pieces.of(url.translate(_LOWER)))
        kinds, texts = zip(*seen) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, type=pa.string()), pa.array(texts, type=pa.string()), pa.array(list(seen.values()), type=pa.int64())], names=["kind", "token", "n"])

    rows = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "kind string, token string, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")).collect()
    return {(r["kind"], r["token"]): r["n"] for r in rows}


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row."""
    rules = compile_rules() if rules is None else rules
    index = RuleIndex(rules, token_counts(pages, rules, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [index.judge(x) for x in batch.column(1).to_pylist()]
            out = list(zip(*got)) if got else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, type=pa.string()) for x in out)], names=["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
