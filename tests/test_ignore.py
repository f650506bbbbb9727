"""Ignore files as git reads them."""

from repolens.sources import repositories


def test_ignore_lines_stop_at_separators_and_the_last_match_decides(spark):
    files = {
        ".gitignore": "/*.js\nsrc/*.gen.ts\ndist/*\n!dist/keep.ts\nout/\n!out/a.ts\nlog?.ts\n**/tmp/**\n*.{x}\n", "a.js": "", "lib/a.js": "", "src/a.gen.ts": "", "src/deep/a.gen.ts": "", "dist/a.ts": "", "dist/keep.ts": "",
        "out/a.ts": "", "src/out": "", "log1.ts": "", "log/.ts": "", "b/tmp/c/d.ts": "", "a.x": "", "b/.gitignore": "!log2.ts\n", "b/log2.ts": "", "c/log2.ts": "",
    }
    tree = spark.createDataFrame([("r", p, t.encode()) for p, t in files.items()], "repo_id string, path string, content binary")
    gone = {"a.js", "src/a.gen.ts", "dist/a.ts", "out/a.ts", "log1.ts", "b/tmp/c/d.ts", "c/log2.ts"}
    assert {r["path"] for r in repositories.walk(tree).collect()} == set(files) - gone


def test_kinds_of_ignore_files(spark):
    """``.ignore`` counts for more than ``.gitignore``, that for more than the repository's own exclude file."""
    files = {".git/info/exclude": "a.ts\nb.ts\n", ".gitignore": "!b.ts\nc.ts\nd.ts\n", "sub/.gitignore": "e.ts\n", ".ignore": "!d.ts\n!e.ts\n", "a.ts": "", "b.ts": "", "c.ts": "", "d.ts": "", "sub/a.ts": "", "sub/e.ts": ""}
    tree = spark.createDataFrame([("r", p, t.encode()) for p, t in files.items()], "repo_id string, path string, content binary")
    assert {r["path"] for r in repositories.walk(tree).collect()} == {".gitignore", "sub/.gitignore", ".ignore", "b.ts", "d.ts", "sub/e.ts"}
