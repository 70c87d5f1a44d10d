"""Package-name expressions: normalisation, requirement parsing, license
resolution, and the fixed name lists the dependency audit relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
#
# Import name -> install (distribution) name, where the two differ.
IMPORT_ALIASES = {
    "yaml": "PyYAML",
    "PIL": "Pillow",
    "sklearn": "scikit-learn",
    "dateutil": "python-dateutil",
    "bs4": "beautifulsoup4",
    "dotenv": "python-dotenv",
    "attr": "attrs",
}
# Module names treated as standard library when no installed metadata exists.
STDLIB_COMMON = [
    "os", "sys", "re", "json", "time", "datetime", "pathlib", "subprocess", "ast",
    "importlib", "typing", "collections", "abc", "math", "random", "shutil", "logging",
    "argparse", "inspect", "copy", "hashlib", "io", "unittest", "pytest", "mock",
    "warnings", "tempfile", "threading", "asyncio", "urllib", "http", "base64", "socket",
    "struct", "pickle", "sqlite3", "csv", "decimal", "fractions", "enum", "functools",
    "itertools", "operator", "traceback", "configparser", "getopt", "platform", "uuid",
    "readline", "textwrap", "bisect", "contextlib", "glob", "heapq", "weakref",
    "webbrowser", "winreg", "xml", "xmlrpc", "zipfile", "zlib",
]
# Declared packages that are build/dev tools and never count as unused (the
# project's own name, read from its manifest, is excluded as well).
TOOL_ONLY = ["setuptools", "wheel", "twine", "black", "pytest-mock", "tomllib", "pip"]
# Used names never reported as undeclared (besides the project's own name).
SELF_NAMES = ["setuptools"]
# License values that count as missing (compared lower-cased).
UNKNOWN_LICENSES = ["unknown", "n/a", ""]
# Package whose license defaults to MIT when nothing else is known.
MIT_DEFAULT_PACKAGE = "pytest"
# Leading name of a requirement string.
REQUIREMENT_NAME = r"^([a-zA-Z0-9._-]+)"
# ---------------------------------------------------------------------------


def normalize_name(c, strip_extras: bool = True) -> Column:
    """``name.split('[')[0].replace('_', '-').lower()``."""
    x = col(c)
    if strip_extras:
        x = F.split(x, r"\[", 2).getItem(0)
    return F.lower(F.replace(x, F.lit("_"), F.lit("-")))


def requirement_name(c) -> Column:
    """Leading distribution name of a requirement string; null if none."""
    n = F.regexp_extract(col(c), REQUIREMENT_NAME, 1)
    return F.when(n != "", n)


def resolve_license(license_col, classifiers, install_name) -> Column:
    """License field unless empty/unknown/n-a; else the last `` :: `` part of
    the first classifier containing ``License ::``; else ``Unknown`` (``MIT``
    for pytest).  ``classifiers`` is an ARRAY<STRING>."""
    lic = col(license_col)
    valid = lambda x: x.isNotNull() & ~F.lower(x).isin(*UNKNOWN_LICENSES)
    first = F.try_element_at(F.filter(F.coalesce(col(classifiers), F.array().cast("array<string>")),
                                  lambda s: F.contains(s, F.lit("License ::"))), F.lit(1))
    from_cls = F.try_element_at(F.split(first, " :: "), F.lit(-1))
    chosen = F.when(valid(lic), lic).when(first.isNotNull(), from_cls).otherwise(lic)
    fallback = F.when(F.lower(col(install_name)) == MIT_DEFAULT_PACKAGE, F.lit("MIT")).otherwise(F.lit("Unknown"))
    return F.when(valid(chosen), chosen).otherwise(fallback)


def alias_install_name(c, aliases: dict | None = None) -> Column:
    """Install name for an import name (identity unless aliased)."""
    m = IMPORT_ALIASES if aliases is None else aliases
    if not m:
        return col(c)
    mapping = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return F.coalesce(mapping[col(c)], col(c))
