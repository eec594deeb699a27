"""Globs, paths, padded numbers and sizes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """An anchored pattern: ``*`` any characters, ``?`` one; matches descendants too; a final slash makes a prefix."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return f"(?s)^{body}.*$" if glob.endswith("/") else f"(?s)^{body}(/.*)?$"


def literal_prefix(glob: str) -> str:
    return re.split(r"[*?]", glob)[0].rstrip("/")


def matches_glob(path: Column, glob: str) -> Column:
    """The pattern, behind its literal prefix, which a scan can push down."""
    test = path.rlike(glob_regex(glob))
    return path.startswith(literal_prefix(glob)) & test if literal_prefix(glob) else test


def selected(path: Column, files: list[str] = (), only: list[str] = (), without: list[str] = (), renamed: list[str] = ()) -> Column:
    """(any of ``files``, or none given) and (any of ``only``) and none of ``without``. With ``renamed``,
    the new names of ``files`` in order, a path is sought under those instead."""
    files = [*renamed[: len(files)], *files[len(renamed) :]] if renamed else files
    one = lambda globs: F.lit(False) if not globs else reduce(lambda a, b: a | b, [matches_glob(path, g) for g in globs])
    out = one(files) if files else F.lit(True)
    out = out & one(only) if only else out
    return out & ~one(without) if without else out


def normalise_separators(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def append_path(prefix: str, path: Column) -> Column:
    """``prefix/path`` with one slash between; leading slashes of ``path`` go."""
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_replace(path, "^/+", ""))


def rename(path: Column, pairs: list[tuple[str, str]] | None = None, prefix: str | None = None) -> Column:
    """``prefix`` before every path; or, of (glob, to) pairs, the first whose glob the path matches puts
    ``to/`` before the whole path; others stay."""
    if prefix is not None:
        return append_path(prefix, path)
    out = path
    for glob, to in reversed(pairs or []):
        out = F.when(matches_glob(path, glob), append_path(to, path)).otherwise(out)
    return out


def folder(path: Column) -> Column:
    """The part up to the last slash and with it; empty without one."""
    return F.regexp_extract(path, "(?s)^(.*/)?", 0)


def extension_key(path: Column, width: int = 5) -> Column:
    """The first ``width`` characters of the last part's final extension, in lower case; empty without a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.instr(name, ".") > 0, F.substring(F.lower(F.element_at(F.split(name, r"\."), -1)), 1, width)).otherwise("")


def padded(number: Column, width: int) -> Column:
    """Zero-padded to ``width``; longer numbers stay whole."""
    return F.when(F.length(number.cast("string")) >= width, number.cast("string")).otherwise(F.lpad(number.cast("string"), width, "0"))


def parse_size(text: str) -> int:
    """A byte count with an optional K, M or G."""
    m = re.fullmatch(r"(\d+)([KMG]?)B?", text.strip().upper())
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2]]


def parse_level(text: str) -> int:
    """'ngN', 'N' or 'auto' (1) as a level of 0 to 9."""
    m = re.fullmatch(r"(?:ng)?(\d)|auto", text.strip().lower())
    if not m:
        raise ValueError(f"not a level: {text}")
    return int(m[1]) if m[1] else 1


def archive_name(name: str, extension: str = ".strata") -> str:
    return name if "." in name.rsplit("/", 1)[-1] else name + extension
