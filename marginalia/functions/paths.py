"""Paths: glob patterns to regular expressions, and the parts of a path as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_glob(pattern: str) -> bool:
    return bool(re.search(r"[*?\[{]", pattern))


def glob_to_regex(pattern: str) -> str:
    """``**/`` any folders or none, ``*`` within a name, ``?`` one character, ``[!x]``, ``{a,b}``; read token by token, the rest is literal."""
    out, at, depth = "^", 0, 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if pattern.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        if c == "[" and (end := pattern.find("]", at + 2)) > 0:
            body = pattern[at + 1 : end]
            negated = body[0] in "!^"
            out += "[" + ("^" if negated else "") + body[negated:].replace("\\", "\\\\").replace("[", "\\[") + "]"
            at = end + 1
            continue
        if c == "{" and "}" in pattern[at:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c) if c in r"\.^$+()|[]{}" else c)
        at += 1
    return out + "$"


def folder(path: Column) -> Column:
    """Everything before the last slash, empty for a file at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def depth(path: Column) -> Column:
    """Number of non-empty parts."""
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def normalized(path: Column) -> Column:
    """Backslashes as slashes, doubled slashes once, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/"), "^/|/$", "")


def sanitized_name(name: Column) -> Column:
    """Characters that file systems refuse become underscores."""
    return F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"))


def with_md(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".md"), path).otherwise(F.concat(path, F.lit(".md")))


def valid_path(path: Column) -> Column:
    """No parent steps, no refused characters, not empty."""
    return (path != "") & ~path.rlike(r'(^|/)\.\.(/|$)|[<>:"|?*\x00-\x1f]')
