"""Coarse graphs as tree, SVG, HTML and JSON. The graph is bounded by its node limit, so this runs on the driver."""

from __future__ import annotations

import html
import json


def layout(nodes: list[str], edges: list[tuple[str, str, int]]) -> tuple[dict[str, int], set[tuple[str, str]]]:
    """(rank of each node, edges that close a circle): longest paths over the edges that do not."""
    out: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b, _ in edges:
        out[a].append(b)
    back: set[tuple[str, str]] = set()
    state: dict[str, int] = {}
    for root in nodes:
        if root in state:
            continue
        state[root], work = 1, [(root, iter(out[root]))]
        while work:
            n, rest = work[-1]
            for b in rest:
                if state.get(b) == 1:
                    back.add((n, b))
                elif b not in state:
                    state[b] = 1
                    work.append((b, iter(out[b])))
                    break
            else:
                state[n] = 2
                work.pop()
    waiting = {n: 0 for n in nodes}
    for a, b, _ in edges:
        waiting[b] += (a, b) not in back
    rank = dict.fromkeys(nodes, 0)
    ready = [n for n in nodes if not waiting[n]]
    while ready:
        n = ready.pop(0)
        for b in out[n]:
            if (n, b) not in back:
                rank[b] = max(rank[b], rank[n] + 1)
                waiting[b] -= 1
                if not waiting[b]:
                    ready.append(b)
    return rank, back


def as_json(nodes: list[dict], edges: list[dict], cycles: list[list[str]]) -> str:
    return json.dumps({"nodes": nodes, "edges": [{**e, "kind": "import"} for e in edges], "cycles": cycles}, indent=2, sort_keys=True)


def as_tree(nodes: list[str], edges: list[tuple[str, str, int]]) -> str:
    """Every node with what it imports, edges back marked."""
    _, back = layout(nodes, edges)
    out = []
    for n in nodes:
        out.append(n)
        mine = sorted((b, w) for a, b, w in edges if a == n)
        for i, (b, w) in enumerate(mine):
            out.append(f"{'└─' if i == len(mine) - 1 else '├─'} {b} ({w}){' ↺' if (n, b) in back else ''}")
    return "\n".join(out)


def as_svg(nodes: list[str], edges: list[tuple[str, str, int]]) -> str:
    rank, back = layout(nodes, edges)
    rows: dict[int, list[str]] = {}
    for n in nodes:
        rows.setdefault(rank[n], []).append(n)
    place = {n: (20 + 200 * i, 20 + 90 * r) for r, names in rows.items() for i, n in enumerate(names)}
    wide, high = max((x for x, _ in place.values()), default=0) + 200, max((y for _, y in place.values()), default=0) + 80
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{high}" font-family="sans-serif" font-size="12">']
    for a, b, w in edges:
        (x, y), (u, v) = place[a], place[b]
        dash = ' stroke-dasharray="4"' if (a, b) in back else ""
        out.append(f'<line x1="{x + 80}" y1="{y + 40}" x2="{u + 80}" y2="{v}" stroke="#888" stroke-width="{min(6, 1 + w // 5)}"{dash}/>')
    for n, (x, y) in place.items():
        out.append(f'<rect x="{x}" y="{y}" width="160" height="40" rx="6" fill="#eef" stroke="#446"/><text x="{x + 80}" y="{y + 24}" text-anchor="middle">{html.escape(n)}</text>')
    return "\n".join([*out, "</svg>"])


def as_html(title: str, nodes: list[str], edges: list[tuple[str, str, int]]) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{as_svg(nodes, edges)}</body></html>"


#: What each depth of the graph shows.
DEPTHS = ((0, "packages"), (1, "directories below a package's root"), (2, "directories of two levels, or files of one"))


def dashboard(roots: list[tuple[str, str, int, int]], depth: int, names: list[str], pairs: list[tuple[str, str, int]], cycles: list[list[str]] = (), as_text: bool = True) -> str:
    """All at one glance: packages (root, package, files, entries), what depths mean, and the coarse graph of one; as text or JSON."""
    if not as_text:
        graph = json.loads(as_json([{"id": n} for n in names], [{"from": a, "to": b, "weight": w} for a, b, w in pairs], list(cycles)))
        guide = [{"depth": d, "shows": text} for d, text in DEPTHS]
        return json.dumps({"schema_version": 1, "depth": depth, "depth_guide": guide, "graph": graph, "scan_roots": [{"root": r, "package": p, "files": f, "entries": e} for r, p, f, e in roots]})
    out = [f"{sum(r[2] for r in roots)} files in {len(roots)} packages", ""]
    out += [f"  {package}  {root or '.'}  {files} files, {entries} entries" for root, package, files, entries in roots]
    out += ["", *(f"  depth {d}: {text}{'  (shown)' if d == depth else ''}" for d, text in DEPTHS), "", f"{len(names)} nodes, {len(pairs)} edges, {len(cycles)} cycles", as_tree(names, pairs)]
    return "\n".join(out)
