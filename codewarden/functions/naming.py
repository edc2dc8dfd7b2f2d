"""Naming styles and conversions between them (SQL expression text)."""

from __future__ import annotations

from codewarden.functions.regex import contains, matches
from codewarden.functions.sql import case, let

# What each style looks like.
STYLES = {
    "camelCase": lambda n: f"{matches(n, r'^[a-z][a-zA-Z0-9]*\z')} AND {matches(n, '[A-Z]')}",
    "snake_case": lambda n: f"{matches(n, r'^[a-z][a-z0-9_]*\z')} AND {contains(n, '_')}",
    "PascalCase": lambda n: matches(n, r"^[A-Z][a-zA-Z0-9]*\z"),
    "kebab-case": lambda n: f"{matches(n, r'^[a-z][a-z0-9-]*\z')} AND {contains(n, '-')}",
    "UPPER_CASE": lambda n: matches(n, r"^[A-Z][A-Z0-9_]*\z"),
}


def _first_of(name: str, styles, otherwise: str) -> str:
    return let(name, lambda n: case([(STYLES[s](n), f"'{s}'") for s in styles], otherwise))


def naming_style(name: str, kebab: bool = False) -> str:
    """First style that fits, else ``unknown``; an all-capitals word counts as PascalCase."""
    styles = ["camelCase", "snake_case", "PascalCase", "kebab-case", "UPPER_CASE"]
    return _first_of(name, [s for s in styles if kebab or s != "kebab-case"], "'unknown'")


def file_style(name: str) -> str:
    """Style of a file's base name as the learner counts it; null when none fits."""
    return _first_of(name, ["camelCase", "kebab-case", "snake_case", "PascalCase"], "NULL")


def identifier_style(name: str) -> str:
    """Style of an identifier as the learner counts it; null when none fits."""
    return _first_of(name, ["camelCase", "snake_case", "PascalCase"], "NULL")


def _raise_after(name: str, separator: str) -> str:
    """Drop each separator and upper-case the character behind it."""
    return (
        f"array_join(zip_with(split({name}, '{separator}.', -1), "
        f"regexp_extract_all({name}, '{separator}(.)', 1), "
        f"(p, c) -> concat(p, upper(coalesce(c, '')))), '')"
    )


def convert_naming_style(name: str, target: str, kebab: bool = True) -> str:
    """Rename to the target style; the first letter of a camelCase result is left as it was."""

    def convert(n):
        spaced = lambda by: f"lower(regexp_replace({n}, '([A-Z])', '{by}$1'))"
        choices = [
            (f"{target} = 'camelCase'", let(_raise_after(n, "_"), lambda m: _raise_after(m, "-"))),
            (f"{target} = 'snake_case'", f"replace({spaced('_')}, '-', '_')"),
            (f"{target} = 'PascalCase'",
             f"concat(upper(left({n}, 1)), {let(f'substr({n}, 2)', lambda m: _raise_after(m, '_'))})"),
        ]
        if kebab:
            choices.append((f"{target} = 'kebab-case'", f"replace({spaced('-')}, '_', '-')"))
        return case(choices, n)

    return let(name, convert)
