"""Column names: existence, validity, globs and join prefixes. Pure Python, driver side."""

from __future__ import annotations

import re

#: Fixed value: the form of names given by the user.
VALID = re.compile(r"[a-zA-Z][a-zA-Z0-9_]*")


class TableError(ValueError):
    """A request that does not fit the table; raised when it is made, not when it runs."""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def existing(names: list[str], columns: list[str]) -> list[str]:
    """names, each checked to be a column."""
    for n in names:
        if not isinstance(n, str):
            raise TableError(f"a column name must be a string, not {n!r}")
        if n not in columns:
            raise TableError(f"no column {n!r} among {columns}")
    return names


def fresh(name: str, columns: list[str]) -> str:
    """name, checked to be valid and not yet a column."""
    if not isinstance(name, str) or not VALID.fullmatch(name):
        raise TableError(f"{name!r} is not a valid new column name")
    if name in columns:
        raise TableError(f"column {name!r} exists already")
    return name


def distinct(names: list[str]) -> list[str]:
    """names, checked to be non-empty strings without repeats."""
    for n in names:
        if not isinstance(n, str) or not n:
            raise TableError(f"{n!r} is no column name")
    if len(set(names)) < len(names):
        raise TableError(f"repeated column names: {sorted({n for n in names if names.count(n) > 1})}")
    return names


#: What a * of a glob matches, and how a replacement names it.
STAR, MATCH = "(.+?)", r"\$(\d+)"


def glob(pattern: str) -> re.Pattern[str]:
    """A whole-name pattern in which * stands for one or more characters."""
    if not isinstance(pattern, str) or not pattern:
        raise TableError("a glob must be a non-empty string")
    return re.compile(STAR.join(map(re.escape, pattern.split("*"))))


def matching(pattern: str, columns: list[str]) -> list[str]:
    p = glob(pattern)
    return [c for c in columns if p.fullmatch(c)]


def glob_renamed(pattern: str, replacement: str, columns: list[str]) -> list[str]:
    """All names after those that match are replaced; $n is what the n-th * (from 0) matched."""
    p = glob(pattern)
    wanted = [int(n) for n in re.findall(MATCH, replacement)]
    if any(n >= p.groups for n in wanted):
        raise TableError(f"{replacement!r} refers to more than the {p.groups} stars of {pattern!r}")

    def name(c: str) -> str:
        m = p.fullmatch(c)
        return re.sub(MATCH, lambda g: m[int(g[1]) + 1], replacement) if m else c

    return distinct([name(c) for c in columns])


def joined(left: list[str], right: list[str]) -> tuple[list[str], list[str]]:
    """Output names of both sides of a join: names on both sides get LEFT. and RIGHT."""
    shared = set(left) & set(right)
    out = [f"LEFT.{c}" if c in shared else c for c in left], [f"RIGHT.{c}" if c in shared else c for c in right]
    distinct(out[0] + out[1])
    return out
