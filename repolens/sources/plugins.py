"""Framework knowledge as a small table: how a package shows that it uses a tool, and which files the tool loads.

Most JavaScript tools only load ``<tool>.config.*`` or ``.<tool>rc*``; those entries are made from a list of
tools by one rule. Further plugins come from TOML files with the same fields.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.globs import glob_to_regex

JS, PY = ("TypeScript",), ("Python",)
_SCRIPTS = "{ts,tsx,js,jsx,mjs,cjs}"


@dataclass(frozen=True)
class Plugin:
    name: str
    languages: tuple[str, ...] = ()
    detect: dict = field(default_factory=lambda: {"always": True})
    entries: tuple[str, ...] = ()
    configs: tuple[str, ...] = ()
    tests: tuple[str, ...] = ()
    decorators: tuple[str, ...] = ()

    @property
    def trigger(self) -> str | None:
        """The dependency that is used by being the framework."""
        return self.detect.get("dependency") or next(iter(self.detect.get("dependencies", [])), None)


def _config_globs(tool: str) -> tuple[str, ...]:
    return (f"{tool}.config.{{ts,mts,cts,js,mjs,cjs}}", f".{tool}rc.{{ts,js,mjs,cjs}}")


#: Tools that load a configuration file of their name: tool -> dependency where it differs.
_CONFIGURED = {
    "astro": "", "ava": "", "babel": "@babel/core", "commitlint": "@commitlint/cli", "cypress": "", "drizzle": "drizzle-orm", "eslint": "", "gatsby": "", "jest": "", "karma": "", "next": "", "nuxt": "", "playwright": "@playwright/test",
    "postcss": "", "prettier": "", "rollup": "", "rsbuild": "@rsbuild/core", "rspack": "@rspack/core", "stylelint": "", "svelte": "@sveltejs/kit", "svgo": "", "tailwind": "tailwindcss", "tsup": "", "tsdown": "", "unocss": "", "vite": "", "vitest": "", "webpack": "", "wrangler": "", "hardhat": "", "lint-staged": "", "metro": "react-native", "release": "semantic-release", "capacitor": "@capacitor/core",
    "contentlayer": "", "kysely": "", "openapi-ts": "openapi-typescript", "oxlint": "", "panda": "@pandacss/dev", "package": "@sanity/pkg-utils", "relay": "relay-compiler", "remark": "remark-cli", "rolldown": "", "svgr": "@svgr/core", "swc": "@swc/core", "syncpack": "", "typedoc": "", "velite": "", "wuchale": "", "cspell": "", "i18next": "", "next-i18next": "", "pm2": "",
}

# The files that frameworks load by convention.
BUILT_IN: tuple[Plugin, ...] = (
    Plugin(
        "_fallback", (), {"always": True},
        (f"index.{_SCRIPTS}", "src/index.{ts,tsx,js,jsx}", "main.{ts,js,mjs}", "src/main.{ts,tsx,js,jsx}", "main.py", "app.py", "__main__.py", "**/__main__.py", "bin/**", "scripts/**", "src/cli/**", "**/cli/*.{ts,tsx,js,jsx,py}"), (),
        ("**/*.{test,spec}.{ts,tsx,js,jsx,mjs}", "**/*.e2e-spec.{ts,tsx,js,jsx}", "**/*.e2e.{ts,tsx,js,jsx}", "**/__tests__/**", "**/test_*.py", "**/*_test.py", "**/tests/**", "**/conftest.py"),
    ),
    Plugin("nextjs", JS, {"dependency": "next"}, (f"{{,src/}}app/**/{{page,layout,route,loading,error,not-found,template,default,global-error,forbidden,unauthorized,opengraph-image,twitter-image,icon,apple-icon,sitemap,robots,manifest}}.{_SCRIPTS}", f"{{,src/}}pages/**/*.{_SCRIPTS}", f"{{,src/}}{{middleware,instrumentation}}.{_SCRIPTS}")),
    Plugin("remix", JS, {"any": [{"dependency": f"@remix-run/{x}"} for x in ("node", "react", "cloudflare", "cloudflare-pages", "deno")]}, (f"app/routes/**/*.{_SCRIPTS}", f"app/{{root,entry.client,entry.server}}.{_SCRIPTS}")),
    Plugin("sveltekit", JS, {"dependency": "@sveltejs/kit"}, ("src/routes/**/+{page,layout,server,error}*.{ts,js}", "src/hooks*.{ts,js}", "src/service-worker.{ts,js}", "src/params/**/*.{ts,js}", "src/**/*.remote.{ts,js}")),
    Plugin("nestjs", JS, {"dependency": "@nestjs/core"}, ("src/main.ts", "src/**/*.module.ts", "src/**/*.controller.ts", "src/**/*.service.ts", "src/**/*.guard.ts", "src/**/*.interceptor.ts", "src/**/*.pipe.ts", "src/**/*.filter.ts", "src/**/*.middleware.ts", "src/**/*.decorator.ts", "src/**/*.gateway.ts", "src/**/*.resolver.ts")),
    Plugin("storybook", JS, {"any": [{"dependency": "storybook"}, {"dependency": "@storybook/"}]}, (f"**/*.stories.{_SCRIPTS}", ".storybook/**")),
    Plugin("express", JS, {"dependency": "express"}, (f"{{,src/}}{{server,app}}.{_SCRIPTS}",)),
    Plugin("cypress-specs", JS, {"dependency": "cypress"}, ("cypress/**",), (), ("cypress/**/*.cy.{ts,tsx,js,jsx}",)),
    Plugin("fastapi", PY, {"dependency": "fastapi"}, ("**/main.py", "**/app.py", "**/asgi.py"), (), (), ("get", "post", "put", "delete", "patch", "websocket", "route")),
    Plugin("flask", PY, {"dependency": "flask"}, ("**/app.py", "**/wsgi.py", "**/__init__.py"), (), (), ("route", "get", "post", "put", "delete")),
    Plugin("django", PY, {"file_exists": "manage.py"}, ("manage.py", "**/{settings,urls,wsgi,asgi,admin,apps,models,views}.py", "**/settings/*.py", "**/migrations/**", "**/management/commands/*.py"), (), (), ("receiver",)),
    Plugin("celery", PY, {"dependency": "celery"}, ("**/celery.py", "**/tasks.py"), (), (), ("task", "shared_task")),
    Plugin("click", PY, {"dependency": "click"}, ("**/cli.py", "**/__main__.py"), (), (), ("command", "group")),
    Plugin("typer", PY, {"dependency": "typer"}, ("**/cli.py", "**/main.py", "**/__main__.py"), (), (), ("command", "callback")),
    Plugin("pytest", PY, {"any": [{"dependency": "pytest"}, {"file_exists": "pytest.ini"}, {"file_exists": "conftest.py"}]}, (), ("pytest.ini",), ("**/test_*.py", "**/*_test.py", "**/tests/**")),
    Plugin("gunicorn", PY, {"dependency": "gunicorn"}, (), ("gunicorn.conf.py", "**/gunicorn.conf.py", "gunicorn_config.py")),
    Plugin("uvicorn", PY, {"dependencies": ["uvicorn", "uvicorn[standard]"]}, ("**/asgi.py",)),
    *(Plugin(tool, JS, {"dependency": dep or tool}, (), _config_globs(tool)) for tool, dep in _CONFIGURED.items()),
)


def _dep(*names: str) -> dict:
    return {"dependency": names[0]} if len(names) == 1 else {"any": [{"dependency": n} for n in names]}


# What further frameworks load by convention; name, dependencies that show it, sources it loads.
_CONVENTIONS = (
    ("angular", ("@angular/core", "ng-packagr"), ("src/public_api.ts", "src/main.ts", "src/app/**/*.component.ts", "src/app/**/*.module.ts", "src/app/**/*.service.ts", "src/app/**/*.guard.ts", "src/app/**/*.pipe.ts", "src/app/**/*.directive.ts", "src/app/**/*.resolver.ts", "src/app/**/*.interceptor.ts", "**/src/main.ts")),
    ("expo", ("expo",), ("App.{ts,tsx,js,jsx}", "app/**/*.{ts,tsx,js,jsx}", "src/App.{ts,tsx,js,jsx}", "app.config.{ts,js,mjs,cjs}", "metro.config.{ts,js,mjs,cjs}")),
    ("react-native", ("react-native",), ("index.{ts,tsx,js,jsx}", "App.{ts,tsx,js,jsx}", "src/App.{ts,tsx,js,jsx}", "app.config.{ts,js}", "metro.config.{ts,js}", "react-native.config.{ts,js}")),
    ("react-router", ("@react-router/dev",), ("app/routes/**/*.{ts,tsx,js,jsx}", "app/root.{ts,tsx,js,jsx}", "app/entry.client.{ts,tsx,js,jsx}", "app/entry.server.{ts,tsx,js,jsx}", "react-router.config.{ts,js,mjs,cjs}", "app/routes.{ts,js,mts,mjs}", "src/routes.{ts,js,mts,mjs}")),
    ("tanstack-router", ("@tanstack/react-router", "@tanstack/solid-router", "@tanstack/start", "@tanstack/react-start", "@tanstack/solid-start"), ("src/server.{ts,tsx,js,jsx}", "src/client.{ts,tsx,js,jsx}", "src/router.{ts,tsx,js,jsx}")),
    ("docusaurus", ("@docusaurus/core",), ("src/pages/**/*.{ts,tsx,js,jsx}", "sidebars.{js,ts}", "src/theme/*.{ts,tsx,js,jsx}", "src/theme/**/index.{ts,tsx,js,jsx}", "docusaurus.config.{ts,js,mjs,cjs}")),
    ("vitepress", ("vitepress",), (".vitepress/theme/**/*.{ts,js,mts,mjs}", "docs/.vitepress/theme/**/*.{ts,js,mts,mjs}", ".vitepress/config.{ts,js,mts,mjs}", "docs/.vitepress/config.{ts,js,mts,mjs}")),
    ("prisma", ("prisma", "@prisma/client"), ("prisma/seed.{ts,js}", "prisma.config.{ts,mts,cts,js,mjs,cjs}", ".config/prisma.{ts,mts,cts,js,mjs,cjs}")),
    ("typeorm", ("typeorm",), ("src/entity/**/*.{ts,js}", "src/entities/**/*.{ts,js}", "src/migration/**/*.{ts,js}", "src/migrations/**/*.{ts,js}", "src/subscriber/**/*.{ts,js}", "src/subscribers/**/*.{ts,js}", "entity/**/*.{ts,js}", "entities/**/*.{ts,js}", "migration/**/*.{ts,js}", "migrations/**/*.{ts,js}", "subscriber/**/*.{ts,js}", "subscribers/**/*.{ts,js}")),
    ("nx", ("nx",), ()),
    ("turborepo", ("turbo",), ()),
    ("electron", ("electron", "electron-builder", "@electron-forge/cli", "electron-vite"), ("src/main/**/*.{ts,tsx,js,jsx,mts,mjs}", "src/preload/**/*.{ts,tsx,js,jsx,mts,mjs}", "electron/main.{ts,js}", "electron.vite.config.{ts,js,mjs}")),
    ("wrangler-files", ("wrangler",), ("src/index.{ts,tsx,js,jsx,mts,mjs}", "src/worker.{ts,tsx,js,jsx,mts,mjs}", "functions/**/*.{ts,tsx,js,jsx,mts,mjs}")),
    ("hardhat-files", ("hardhat",), ("test/**/*.{ts,js}", "scripts/**/*.{ts,js}", "tasks/**/*.{ts,js}", "deploy/**/*.{ts,js}", "ignition/modules/**/*.{ts,js}", "hardhat.config.{ts,js,cjs,mjs}")),
    ("knex", ("knex",), ("migrations/**/*.{ts,js}", "seeds/**/*.{ts,js}", "knexfile.{ts,js}")),
    ("drizzle-files", ("drizzle-orm",), ("drizzle/**/*.{ts,js}",)),
    ("ember", ("ember-source", "ember-cli", "@embroider/core", "@embroider/compat", "@glimmer/component"), ("app/app.{js,ts}", "app/router.{js,ts}", "app/components/**/*.{js,ts}", "app/routes/**/*.{js,ts}", "app/controllers/**/*.{js,ts}", "app/models/**/*.{js,ts}", "app/services/**/*.{js,ts}", "app/helpers/**/*.{js,ts}", "app/modifiers/**/*.{js,ts}")),
    ("gatsby-files", ("gatsby",), ("src/pages/**/*.{ts,tsx,js,jsx}", "src/templates/**/*.{ts,tsx,js,jsx}", "src/api/**/*.{ts,js}", "gatsby-config.{ts,js,mjs}", "gatsby-node.{ts,js,mjs}", "gatsby-browser.{ts,tsx,js,jsx}", "gatsby-ssr.{ts,tsx,js,jsx}")),
    ("nuxt-files", ("nuxt", "nuxt3"), ("pages/**/*.{ts,tsx,js,jsx}", "layouts/**/*.{ts,tsx,js,jsx}", "middleware/**/*.{ts,js}", "server/**/*.{ts,js}", "plugins/*.{ts,tsx,js,jsx,mts,cts,mjs,cjs}", "plugins/**/index.{ts,tsx,js,jsx,mts,cts,mjs,cjs}", "composables/*.{ts,tsx,js,jsx,mts,cts,mjs,cjs}", "utils/*.{ts,tsx,js,jsx,mts,cts,mjs,cjs}")),
    ("astro-files", ("astro",), ("src/pages/**/*.{ts,tsx,js,jsx,mts,mjs,cts,cjs}", "src/content/**/*.{ts,js,mts,mjs,cts,cjs}", "src/middleware.{js,ts,mjs,mts,cjs,cts}", "src/middleware/index.{js,ts,mjs,mts,cjs,cts}", "src/actions/index.{js,ts,mjs,mts,cjs,cts}")),
    ("adonis", ("@adonisjs/core",), ("server.{ts,js}", "ace.{ts,js}", "bin/**/*.{ts,js}", "start/**/*.{ts,js}", "providers/**/*.{ts,js}", "commands/**/*.{ts,js}", "config/**/*.{ts,js}", "contracts/**/*.ts", "database/**/*.{ts,js}", "app/**/*.ts")),
    ("qwik", ("@builder.io/qwik", "@builder.io/qwik-city", "@qwik.dev/core", "@qwik.dev/router"), ("src/routes/**/index.{ts,tsx,js,jsx}", "src/routes/**/layout.{ts,tsx,js,jsx}", "src/routes/**/plugin.{ts,js}", "src/routes/**/service-worker.{ts,js}", "adapters/**/vite.config.{ts,js}", "src/entry.*.{ts,tsx,js,jsx}", "src/root.{ts,tsx,js,jsx}")),
    ("sanity", ("sanity", "@sanity/"), ("schemas/**/*.{ts,tsx,js,jsx}", "sanity/**/*.{ts,tsx,js,jsx}", "sanity.config.{ts,js}", "sanity.cli.{ts,js}")),
    ("redwoodsdk", ("rwsdk",), ("src/worker.{ts,tsx,js,jsx,mts,mjs}",)),
    ("convex", ("convex",), ("convex/**/*.{ts,js}",)),
    ("supabase", ("supabase",), ("supabase/functions/*/index.{ts,tsx,js,jsx,mts,mjs,cts,cjs}",)),
    ("k6", ("k6",), ("**/*.k6.{js,ts,mjs,cjs,mts,cts}",)),
    ("webdriverio", ("webdriverio", "@wdio/"), ("test/**/*.{ts,js}", "e2e/**/*.{ts,js}", "**/*.e2e.{ts,js}", "wdio.conf.{ts,js}")),
    ("cucumber", ("@cucumber/cucumber",), ("features/**/*.{ts,js}", "**/*.steps.{ts,js}", "step_definitions/**/*.{ts,js}", "support/**/*.{ts,js}", "cucumber.{js,cjs,mjs,ts}")),
    ("mocha", ("mocha",), ("test/**/*.{ts,tsx,js,jsx}", "tests/**/*.{ts,tsx,js,jsx}", "spec/**/*.{ts,tsx,js,jsx}", ".mocharc.{js,cjs,mjs}")),
    ("tap", ("tap",), ("test/**/*.{js,cjs,mjs,jsx,ts,cts,mts,tsx}", "tests/**/*.{js,cjs,mjs,jsx,ts,cts,mts,tsx}", "test.{js,cjs,mjs,jsx,ts,cts,mts,tsx}", "tests.{js,cjs,mjs,jsx,ts,cts,mts,tsx}")),
    ("ava-files", ("ava",), ("test/**/*.{ts,tsx,js,jsx}", "tests/**/*.{ts,tsx,js,jsx}")),
    ("nitro", ("nitropack",), ("server/**/*.{ts,js}", "routes/**/*.{ts,js}", "api/**/*.{ts,js}", "middleware/**/*.{ts,js}", "nitro.config.{ts,js}")),
    ("msw", ("msw",), ("**/mocks/**/*.{ts,tsx,js,jsx}", "public/mockServiceWorker.js")),
    ("capacitor-files", ("@capacitor/core", "@capacitor/cli"), ("capacitor.config.{ts,js}",)),
    ("plop", ("plop",), ("plopfile.{js,cjs,mjs,ts}",)),
    ("lit", ("lit", "lit-element", "lit-html"), ()),
    ("stryker", ("@stryker-mutator/core", "stryker"), ("**/stryker.conf.{js,mjs,cjs,ts}", "**/stryker.config.{js,mjs,cjs,ts}")),
    ("biome", ("@biomejs/biome",), ()),
    ("bun", ("bun-types", "@types/bun"), ("**/*.test.{js,jsx,ts,tsx}", "**/*_test.{js,jsx,ts,tsx}", "**/*.spec.{js,jsx,ts,tsx}", "**/*_spec.{js,jsx,ts,tsx}")),
    ("c8", ("c8",), ()),
    ("changesets", ("@changesets/cli",), ()),
    ("commitizen", ("commitizen",), ()),
    ("content-collections", ("@content-collections/core", "@content-collections/vite", "@content-collections/next"), ("content-collections.{ts,js,mts,mjs}",)),
    ("danger", ("danger",), ("**/dangerfile.{js,ts,mjs,cjs}",)),
    ("dependency-cruiser", ("dependency-cruiser",), (".dependency-cruiser.{js,cjs,mjs}",)),
    ("graphql-codegen", ("@graphql-codegen/cli",), ("codegen.{ts,js}", "graphql.config.{ts,js}")),
    ("husky", ("husky",), ()),
    ("i18next-files", ("i18next", "react-i18next", "vue-i18n", "next-i18next"), ("src/i18n.{ts,js,mjs}", "src/i18n/index.{ts,js}", "i18n.{ts,js,mjs}", "i18n/index.{ts,js}")),
    ("kysely-files", ("kysely", "kysely-ctl"), ("migrations/**/*.{ts,js}", "src/migrations/**/*.{ts,js}")),
    ("lefthook", ("lefthook", "@evilmartians/lefthook"), ()),
    ("lexical", ("lexical", "@lexical/"), ()),
    ("markdownlint", ("markdownlint", "markdownlint-cli", "markdownlint-cli2"), (".markdownlint-cli2.{cjs,mjs}",)),
    ("mintlify", ("mint", "mintlify"), ()),
    ("next-intl", ("next-intl",), ("src/i18n.{ts,js}", "src/i18n/request.{ts,js}", "i18n.{ts,js}", "i18n/request.{ts,js}")),
    ("nodemon", ("nodemon",), ()),
    ("nyc", ("nyc",), ()),
    ("opencode", ("@opencode-ai/sdk",), (".opencode/plugins/**/*.{js,ts,mjs,cjs,mts,cts}",)),
    ("parcel", ("parcel", "@parcel/"), ()),
    ("pm2-files", ("pm2",), ("ecosystem.config.{js,cjs}",)),
    ("pnpm", ("pnpm",), (".pnpmfile.cjs", ".pnpmfile.mjs")),
    ("rspress", ("rspress", "@rspress/"), ()),
    ("sentry", ("@sentry/nextjs", "@sentry/react", "@sentry/node", "@sentry/browser"), ("sentry.client.config.{ts,js,mjs}", "sentry.server.config.{ts,js,mjs}", "sentry.edge.config.{ts,js,mjs}")),
    ("simple-git-hooks", ("simple-git-hooks",), ("simple-git-hooks.{js,cjs}",)),
    ("tsd", ("tsd",), ("**/*.test-d.{ts,tsx}", "test-d/**/*.{ts,tsx}")),
    ("typescript", ("typescript",), ()),
    ("expo-router", ("expo-router",), ("expo-env.d.ts",)),
    ("fumadocs", ("fumadocs-mdx", "fumadocs-core", "fumadocs-ui"), ("source.config.{ts,tsx,js,jsx,mts,mjs,cts,cjs}",)),
)


BUILT_IN += tuple(Plugin(name, JS, _dep(*found), globs) for name, found, globs in _CONVENTIONS)


def load(paths: list[str]) -> list[Plugin]:
    """Plugins of TOML files, in order; unreadable files are left out."""
    out = []
    for path in paths:
        try:
            d = tomllib.loads(Path(path).read_text())
            languages = d.get("languages") or [x for x in [d.get("language")] if x]
            known = {"python": "Python", "typescript": "TypeScript", "javascript": "TypeScript"}
            globs = {k: tuple(x["glob"] for x in d.get(k, [])) for k in ("entry_points", "config_patterns", "test_patterns")}
            out.append(Plugin(d["name"], tuple(dict.fromkeys(known.get(x, x) for x in languages)), d.get("detect", {}), globs["entry_points"], globs["config_patterns"], globs["test_patterns"], tuple(d.get("route_decorators", ()))))
        except (OSError, ValueError, KeyError, TypeError):
            continue
    return out


def registry(extra: list[Plugin] = ()) -> list[Plugin]:
    """Built-in plugins, then others; of equal names the first counts."""
    return list({p.name: p for p in reversed([*BUILT_IN, *extra])}.values())[::-1]


def detected(rule: dict, dependencies: Column, files: Column) -> Column:
    """A detection rule as an expression over a package's dependencies and the names of files in its root."""

    def has(dep: str) -> Column:
        return F.exists(dependencies, lambda d: d.startswith(dep)) if dep.endswith("/") else F.array_contains(dependencies, dep)

    if rule.get("always"):
        return F.lit(True)
    for word, start in (("any", False), ("all", True)):
        if word in rule:
            out = F.lit(start)
            for r in rule[word]:
                out = out & detected(r, dependencies, files) if start else out | detected(r, dependencies, files)
            return out
    tests = [has(d) for d in [*([rule["dependency"]] if "dependency" in rule else []), *rule.get("dependencies", [])]]
    tests += [F.array_contains(files, f) for f in [*([rule["file_exists"]] if "file_exists" in rule else []), *rule.get("files_exist", [])]]
    if not tests:
        return F.lit(True)
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def pattern(globs: list[str]) -> str | None:
    parts = [r[len("(?s)^") : -1] for g in globs if (r := glob_to_regex(g))]
    return "(?:" + "|".join(parts) + ")" if parts else None


def with_plugins(packages, plugins: list[Plugin], extra_entries: list[str] = ()):
    """packages with plugins, framework_deps, route_decorators, entry_pattern and test_pattern of the active plugins.

    packages needs language, dependencies and root_files. Plugins become columns of one projection; nothing is joined.
    """
    active = [F.when((F.lit(not p.languages) | F.col("language").isin(list(p.languages) or [""])) & detected(p.detect, F.col("dependencies"), F.col("root_files")), F.lit(True)).otherwise(False) for p in plugins]
    marked = packages.withColumn("_on", F.array(*active))

    def gather(values: list[list[str]]) -> Column:
        return F.array_distinct(F.flatten(F.array(*[F.when(F.get("_on", F.lit(i)), F.array(*[F.lit(x) for x in v]).cast("array<string>")).otherwise(F.array().cast("array<string>")) for i, v in enumerate(values)])))

    one = lambda values: [[v] if v else [] for v in values]
    whole = lambda parts: F.concat(F.lit("(?s)^(?:"), F.array_join(parts, "|"), F.lit(")$"))
    return marked.select(
        *packages.columns,
        gather([[p.name] for p in plugins]).alias("plugins"),
        gather(one([p.trigger for p in plugins])).alias("framework_deps"),
        gather([list(p.decorators) for p in plugins]).alias("route_decorators"),
        whole(F.concat(gather(one([pattern([*p.entries, *p.configs]) for p in plugins])), F.array(F.lit(pattern(list(extra_entries)) or "(?!)")))).alias("entry_pattern"),
        whole(F.concat(gather(one([pattern(list(p.tests)) for p in plugins])), F.array(F.lit("(?!)")))).alias("test_pattern"),
    )
