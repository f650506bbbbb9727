"""Language front-ends: a file's text to its facts, as plain dictionaries. Pure functions, run on executors."""

from __future__ import annotations

from repolens.sources.frontends.common import Facts, language_of
from repolens.sources.frontends.css import extract_css
from repolens.sources.frontends.python import extract_python
from repolens.sources.frontends.script import extract_script


def extract(path: str, text: str) -> dict:
    """Facts of one file; a file that cannot be read gives empty facts, never an error."""
    language = language_of(path)
    try:
        if language == "Python":
            return extract_python(text)
        if language == "Css":
            return extract_css(text)
        return extract_script(text, language)
    except RecursionError:
        return Facts(text).done()
