"""Small repositories as text, one per scenario."""

REPOSITORIES = {
    "mixed": {
        "package.json": '{"name": "root", "private": true}',
        "apps/web/package.json": '{"name": "web", "dependencies": {"next": "1", "react": "1", "lodash": "1", "@acme/shared": "*"}}',
        "apps/web/tsconfig.json": '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["src/*"]},},\n}',
        "apps/web/app/page.tsx": 'import React from "react";\nimport { greet, unusedName } from "@acme/shared";\nimport { Card } from "~/ui/card";\nexport default function Page() { return <Card title={greet("x")} />; }\n',
        "apps/web/src/ui/card.tsx": 'export const Card = ({ title }) => <div>{title}</div>;\nexport const Orphaned = 1;\n',
        "apps/web/src/dead.ts": 'import { chain } from "./deader";\nexport const dead = chain;\n',
        "apps/web/src/deader.ts": "export const chain = 1;\n",
        "apps/web/src/helper.ts": "export const helper = 1;\n",
        "apps/web/src/__tests__/smoke.test.ts": 'import { helper } from "../helper";\nhelper;\n',
        "packages/shared/package.json": '{"name": "@acme/shared"}',
        "packages/shared/index.ts": 'export { greet } from "./greet";\nexport * from "./more";\n',
        "packages/shared/greet.ts": "export function greet(name: string) { return name; }\n",
        "packages/shared/more.ts": "export const unusedName = 1;\n",
        "apps/api/pyproject.toml": '[project]\nname = "api"\ndependencies = ["fastapi>=0.1", "pyyaml", "requests"]\n',
        "apps/api/app/__init__.py": "",
        "apps/api/app/main.py": "import yaml\nfrom app import routes\nfrom app.models import User\n\nprint(yaml, routes, User)\n",
        "apps/api/app/routes.py": "from fastapi import APIRouter\n\nrouter = APIRouter()\n\n\n@router.get('/x')\ndef handler():\n    return 1\n",
        "apps/api/app/models.py": "from .schema import Base\n\n\nclass User(Base):\n    pass\n",
        "apps/api/app/schema.py": "from . import models\n\n\nclass Base:\n    owner = models\n",
        "apps/api/app/orphan.py": "X = 1\n",
    },
    "roles": {
        "eslint.config.mjs": 'import { shared } from "./lint-shared";\nexport default [shared];\n',
        "lint-shared.ts": "export const shared = 1;\n",
        "env.d.ts": "declare const X: string;\n",
        "index.ts": "export {};\n",
        "orphan.ts": "export const o = 1;\n",
        "pkg/__init__.py": "",
        "pkg/live.py": "Y = 1\n",
        "main.py": "import pkg.live\n\nprint(pkg)\n",
        "deadpkg/__init__.py": "",
        ".gitignore": "generated/\n",
        "generated/out.ts": "export const g = 1;\n",
        "node_modules/x/index.js": "module.exports = 1;\n",
    },
    "symbols": {
        "index.ts": 'import { Color } from "./colors";\nimport { Widget } from "./widget";\nimport type { Shape } from "./types";\nconst w: Shape = new Widget().open(Color.Red);\nw;\n',
        "colors.ts": "export enum Color {\n  Red,\n  Green,\n  Blue,\n}\n",
        "widget.ts": "export class Widget {\n  private cache = 1;\n  private kept = 2;\n  #hidden() {\n    return 1;\n  }\n  open(a: number, extra: number) {\n    return this.kept + a;\n  }\n}\n",
        "types.ts": "export interface Shape { k: number }\nexport type Dead = string;\n",
        "service.py": "class Service:\n    def run(self):\n        return self._used()\n\n    def _used(self):\n        return 1\n\n    def _dead(self):\n        return 2\n\n\ndef act(a, leftover):\n    return a\n",
        "main.py": "from service import Service, act\n\nService().run()\nact(1, 2)\n",
    },
    "annotations": {
        "index.ts": 'import { stale } from "./lib";\nstale;\n/** @internal -- checked */\nexport const guarded = 1;\n',
        "lib.ts": "/** @public -- api */\nexport const open = 1;\n/** @expected-unused */\nexport const stale = 2;\n/** @expected-unused -- later */\nexport const quiet = 3;\n// lint-ignore-next-line unused-export -- kept for now\nexport const hidden = 4;\nexport const flagged = 5;\n",
    },
    "complexity": {
        "index.ts": "export function knot(a: number) {\n  if (a > 1) {\n    for (const x of [a]) {\n      if (x && a) {\n        while (x) { return x ? 1 : 2; }\n      }\n    }\n  }\n  return 0;\n}\nknot(1);\n",
        "legacy/old.ts": "export function old(a: number) {\n  if (a > 1) {\n    for (const x of [a]) {\n      if (x && a) {\n        while (x) { return x ? 1 : 2; }\n      }\n    }\n  }\n  return 0;\n}\n",
        "big.ts": "export function big() {\n" + "".join(f"  const v{i} = {i};\n" for i in range(70)) + "}\n",
    },
    "duplication": {
        "src/a.ts": "export function total(list: number[]) {\n  let sum = 0;\n  for (const item of list) { sum += item * 2; }\n  if (sum > 10) { return sum; }\n  return 0;\n}\n",
        "src/b.ts": "export function price(rows: number[]) {\n  let acc = 0;\n  for (const row of rows) { acc += row * 2; }\n  if (acc > 10) { return acc; }\n  return 0;\n}\n",
        "src/c.py": "def f(x):\n    return x\n",
    },
    "defaults": {
        "index.ts": 'import run from "./run";\nconst fs = require("fs");\nrun(fs, import("./lazy"));\n',
        "run.ts": "export default function go(a, b) { return [a, b]; }\nexport const spare = 1;\n",
        "lazy.ts": "export const all = 1;\n",
    },
    "policy": {
        "src/domain/model.ts": 'import axios from "axios";\nimport { db } from "../infra/db";\naxios.get(db);\neval("1");\n',
        "src/infra/db.ts": "export const db = 1;\n",
        "worker.py": "import subprocess\n\nsubprocess.run([])\n",
    },
    "style": {
        "src/App.tsx": 'export const App = () => <div className="card used" style={{ color: "var(--inline)" }} />;\n',
        "src/theme.css": ":root { --brand: #fff; --dead: 1px; --inline: red; }\n.card { color: var(--brand); }\n.used { margin: var(--missing); }\n.gone, .lost:hover { margin: 0; }\n",
    },
}
