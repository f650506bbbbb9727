"""Configuration of an analysis: defaults, a TOML file, presets and policy packs."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from repolens.operators.rules import Layer, PolicyRule

LEVELS = {"off": 0, "warn": 1, "error": 2}

# Layers by preset; in feature-sliced each may use those before it.
_SLICES = ("shared", "entities", "features", "widgets", "pages", "processes", "app")
PRESETS = {
    "layered": [
        Layer("domain", ("**/domain/**",)),
        Layer("application", ("**/application/**", "**/app/**"), ("domain",)),
        Layer("infrastructure", ("**/infrastructure/**", "**/infra/**"), ("domain", "application")),
        Layer("ui", ("**/ui/**", "**/presentation/**", "**/web/**"), ("application", "domain")),
    ],
    "hexagonal": [Layer("core", ("**/core/**", "**/domain/**")), Layer("ports", ("**/ports/**",), ("core",)), Layer("adapters", ("**/adapters/**", "**/infrastructure/**"), ("ports", "core"))],
    "feature-sliced": [Layer(name, (f"**/{name}/**",), _SLICES[:i]) for i, name in enumerate(_SLICES)],
}


@dataclass(frozen=True)
class Override:
    paths: tuple[str, ...]
    max_cyclomatic: int
    max_cognitive: int
    max_loc: int
    max_crap: float
    severity: int
    reason: str


@dataclass(frozen=True)
class Config:
    severities: dict[str, int] = field(default_factory=dict)
    require_reason: int = 0
    ignore: tuple[str, ...] = ()
    fail_on: int = 2
    complexity: bool = True
    max_cyclomatic: int = 20
    max_cognitive: int = 15
    max_loc: int = 60
    max_crap: float = 30.0
    complexity_overrides: tuple[Override, ...] = ()
    duplication: bool = False
    duplication_mode: str = "mild"
    min_tokens: int = 30
    skip_local: bool = False
    style: bool = False
    policy: tuple[PolicyRule, ...] = ()
    layers: tuple[Layer, ...] = ()
    entry_points: tuple[str, ...] = ()
    plugins: tuple[str, ...] = ()
    baseline: str | None = None
    #: Default imports use only the name ``default``, and require() and import() bind it: two known false alarms.
    strict_parity: bool = False


def _level(value: object, default: int = 1) -> int:
    value = value.get("level") if isinstance(value, dict) else value
    return LEVELS.get(str(value), default)


def _policies(items: list[dict]) -> list[PolicyRule]:
    out = []
    for r in items:
        if r.get("kind") in ("banned-import", "banned-call", "banned-effect") and r.get("id"):
            names = r.get("specifiers") or r.get("callees") or r.get("effects") or []
            out.append(PolicyRule(r["id"], r["kind"], tuple(names), tuple(r.get("paths", ())), _level(r.get("severity", "warn")), r.get("hint", "")))
    return out


def parse(text: str, folder: Path | None = None) -> Config:
    """A configuration from TOML text; text that does not parse gives the defaults. Packs are read below ``folder``."""
    try:
        d = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return Config()
    rules = dict(d.get("rules", {}))
    reason = rules.pop("require-suppression-reason", None)
    c = d.get("complexity", {})
    least = lambda k, default: max(1, int(c.get(k, default)))
    base = Config(max_cyclomatic=least("max-cyclomatic", 20), max_cognitive=least("max-cognitive", 15), max_loc=max(1, int(c.get("max-loc", c.get("max-unit-size", 60)))), max_crap=float(c.get("max-crap", 30.0)))
    overrides = tuple(
        Override(tuple(o.get("paths", ())), int(o.get("max-cyclomatic", base.max_cyclomatic)), int(o.get("max-cognitive", base.max_cognitive)), int(o.get("max-loc", o.get("max-unit-size", base.max_loc))), float(o.get("max-crap", base.max_crap)), _level(o.get("severity", "warn")), o["reason"])
        for o in c.get("override", []) if o.get("reason")
    )
    dup, pol, bounds = d.get("duplication"), d.get("policy", {}), d.get("boundaries", {})
    policies = _policies(pol.get("rule", []))
    for pack in pol.get("packs", []):
        try:
            policies += _policies(tomllib.loads(((folder or Path()) / pack).read_text()).get("rule", []))
        except (OSError, tomllib.TOMLDecodeError):
            continue
    layers = [*PRESETS.get(bounds.get("preset", ""), []), *(Layer(x["name"], tuple(x.get("paths", ())), tuple(x.get("allow", ()))) for x in bounds.get("layer", []))]
    fail = d.get("audit", {}).get("fail-on", "error")
    mode = (dup or {}).get("mode", "mild")
    return replace(
        base, severities={k: _level(v) for k, v in rules.items()}, require_reason=_level(reason) if reason is not None else 0, ignore=tuple(d.get("ignore", {}).get("paths", ())), fail_on=min([_level(x, 2) for x in (fail if isinstance(fail, list) else [fail])] or [2]),
        complexity=c.get("enabled", True), complexity_overrides=overrides, duplication=dup is not None and dup.get("enabled", True), duplication_mode=mode if mode in ("exact", "mild", "weak", "semantic") else "mild", min_tokens=max(1, int((dup or {}).get("min-tokens", 30))), skip_local=bool((dup or {}).get("skip-local", False)),
        style=bool(d.get("style", {}).get("enabled", "style" in d)), policy=tuple(policies), layers=tuple(layers), entry_points=tuple(d.get("entry_points", {}).get("add", ())), plugins=tuple(d.get("plugins", {}).get("paths", ())), baseline=d.get("audit", {}).get("baseline"),
    )


def load(path: str) -> Config:
    """The configuration at ``path``; without a file the defaults."""
    try:
        return parse(Path(path).read_text(), Path(path).parent)
    except OSError:
        return Config()
