"""Row-expanding extraction over source corpora.

One Python step, ``source_tokens``, parses each file inside an Arrow batch
and emits a flat token stream: every import, class and function of the file
with its nesting level and its place in reading order.  Everything that the
operators add -- module-level selection, distinct references, numbering,
first match, roll-ups, error texts -- is a Spark expression over the tokens.
A file that can't be parsed is one ``error`` token, never a failed job.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_name, requirement_name
from ..functions.text import is_safe_path

TOKENS_SCHEMA = ("level int, seq int, kind string, name string, ref string, members array<string>, depth int, lineno int, "
                 "has_docstring boolean, code string")
_TOKEN = [f.split()[0] for f in TOKENS_SCHEMA.split(", ")]

# Fixed values that must equal the reference's behaviour: error texts.
UNSAFE_ERROR = "Error: Access to .env files is strictly prohibited."
STRUCTURE_ERROR = "Error parsing AST: "
FUNCTION_ERROR = "Error extracting function: "


# ``ast.unparse`` is recursive: some ten frames a level of a tree.  The parser itself refuses a tree of more than some thousand levels.
_UNPARSE_FRAMES = 300_000
_DEFINITIONS = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


def _unparse(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except RecursionError:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, _UNPARSE_FRAMES))
        try:
            return ast.unparse(node)
        finally:
            sys.setrecursionlimit(limit)


class _TokenStream:
    """Collects a file's tokens.  ``level`` is the distance from the module,
    ``seq`` the reading order, ``depth`` the number of enclosing definitions;
    ``(level, seq)`` is therefore breadth-first order.  The walk keeps its own
    stack: a tree may be deeper than Python's recursion limit."""

    def __init__(self, with_code: bool = True):
        self.rows: list[tuple] = []
        self.level = self.depth = 0
        self.with_code = with_code

    def emit(self, kind, name, node, ref=None, members=None, doc=None, code=None):
        self.rows.append((self.level, len(self.rows), kind, name, ref, members, self.depth, node.lineno, doc, code))

    def walk(self, tree):
        open_nodes = [(tree, 0, 0)]
        while open_nodes:
            node, self.level, self.depth = open_nodes.pop()
            emitter = getattr(self, f"visit_{type(node).__name__}", None)
            if emitter is not None:
                emitter(node)
            depth = self.depth + isinstance(node, _DEFINITIONS)
            open_nodes += [(child, self.level + 1, depth) for child in ast.iter_child_nodes(node)][::-1]

    def visit_Import(self, node):
        for target in node.names:
            self.emit("import", target.name, node, ref=target.name.partition(".")[0])

    def visit_ImportFrom(self, node):
        origin = node.module or ""
        root = origin.partition(".")[0] if not node.level else ""
        for target in node.names:
            self.emit("import", f"{origin}.{target.name}", node, ref=root or None)

    def visit_ClassDef(self, node):
        inner = _TokenStream(False)
        for part in node.body:
            if type(part) is ast.FunctionDef:
                inner.emit("method", part.name, part)
        self.emit("class", node.name, node, members=[row[3] for row in inner.rows])

    def _function(self, node, kind):
        code = None
        if self.with_code:
            try:
                code = _unparse(node)
            except (ValueError, RecursionError):
                code = None
        self.emit(kind, node.name, node, members=[p.arg for p in node.args.args], doc=bool(ast.get_docstring(node)), code=code)

    def visit_FunctionDef(self, node):
        self._function(node, "function")

    def visit_AsyncFunctionDef(self, node):
        self._function(node, "async")


def token_rows(content: str | None, with_code: bool = True) -> list[tuple]:
    """Tokens of one file as rows of TOKENS_SCHEMA; null reads as empty."""
    stream = _TokenStream(with_code)
    try:
        stream.walk(ast.parse(content or ""))
    except Exception as e:  # noqa: BLE001 -- SyntaxError, null bytes, recursion: a value, not a failure
        return [(0, 0, "error", str(e), None, None, 0, None, None, None)]
    return stream.rows


def source_tokens(files: DataFrame, content_col: str = "content", keys=("path",), with_code: bool = True) -> DataFrame:
    """``keys`` plus TOKENS_SCHEMA, one row per token.  Parallelism is that of
    the input's partitions: size them where the corpus is read
    (``spark.sql.files.maxPartitionBytes``)."""
    keys = list(keys)
    src = files.select(*keys, F.col(content_col).alias("__content"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [(i, row) for i, text in enumerate(pdf["__content"]) for row in token_rows(text, with_code)]
            if not found:
                continue  # an empty batch would not serialise as Arrow
            out = pd.concat([pdf[keys].iloc[[i for i, _ in found]].reset_index(drop=True),
                             pd.DataFrame([row for _, row in found], columns=_TOKEN)], axis=1)
            yield out.astype({"level": "int32", "seq": "int32", "depth": "int32", "lineno": "Int32", "has_docstring": "boolean"})

    return src.mapInPandas(run, f"{schema}, {TOKENS_SCHEMA}")


def extract_refs(files: DataFrame, path_col: str = "path", content_col: str = "content",
                 keys=None) -> DataFrame:
    """Distinct top-level module names imported by each file, at any
    depth.  Relative imports are skipped; an unparseable file yields no rows.
    ``keys`` (default: the path column) are carried to every output row, so a
    ``repo`` column survives without a join back."""
    keys = list(keys or [path_col])
    return (source_tokens(files, content_col, keys, with_code=False).where(F.col("ref").isNotNull())
            .select(*keys, "ref").distinct())


def extract_links(pages: DataFrame, path_col: str = "url", html_col: str = "html") -> DataFrame:
    """U1, link variant: distinct first path component of every ``href`` of
    a page, all native expressions."""
    h = pages.select(F.col(path_col).alias("path"),
                     F.explode(F.regexp_extract_all(html_col, F.lit(r'href="([^"]+)"'), F.lit(1))).alias("h"))
    return (h.select("path", F.regexp_extract("h", r"^/?([^/?#]+)", 1).alias("ref"))
            .where(F.col("ref") != "").distinct())


def extract_structure(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Module-level classes (with sync method names), sync functions
    (with positional argument names) and imports (``module.name``; relative
    ``from . import y`` gives ``.y``), numbered in reading order, with line
    numbers.  A file that does not parse and one whose path is unsafe yield
    one ``error`` row."""
    src = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    safe = is_safe_path(F.coalesce("path", F.lit("")))
    tokens = source_tokens(src.where(safe), with_code=False)
    top = tokens.where((F.col("kind") == "error") | ((F.col("level") == 1) & (F.col("kind") != "async")))
    name = F.when(F.col("kind") == "error", F.concat(F.lit(STRUCTURE_ERROR), "name")).otherwise(F.col("name"))
    # A file's tokens are numbered together: the window is of one file's size.
    pos = F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1
    refused = src.where(~safe).select("path", F.lit(0).alias("pos"), F.lit("error").alias("kind"), F.lit(UNSAFE_ERROR).alias("name"),
                                      F.lit(None).cast("array<string>").alias("members"), F.lit(None).cast("int").alias("lineno"))
    return top.select("path", pos.alias("pos"), "kind", name.alias("name"), "members", "lineno").unionByName(refused)


def extract_functions(files: DataFrame, path_col: str = "path", content_col: str = "content",
                      with_code: bool = True) -> DataFrame:
    """Every function (sync and async, any depth) with its place ((level,
    seq) is breadth-first order), docstring flag and (``with_code``)
    re-rendered source."""
    src = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    return (source_tokens(src, with_code=with_code).where(F.col("kind").isin("function", "async"))
            .select("path", "level", "seq", "name", (F.col("kind") == "async").alias("is_async"), "depth", "lineno", "has_docstring", "code"))


def find_function(files: DataFrame, requests: DataFrame, path_col: str = "path",
                  content_col: str = "content") -> DataFrame:
    """Per ``(path, function_name)`` request, the re-rendered source of
    the first (breadth-first) sync function of that name; else ``found`` is
    false and ``code`` the error text: unsafe path, missing or unreadable
    file (no row, or null content), unparseable file, or no such function.
    Only the requested files are parsed (semi join before Python)."""
    req = requests.select("path", "function_name").distinct()
    wanted = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")) \
        .where(F.col("content").isNotNull() & is_safe_path("path")) \
        .join(req.select("path").distinct(), "path", "left_semi")
    tokens = source_tokens(wanted).where(F.col("kind").isin("function", "error"))
    # One row per file and name; a parsed file always has its "" row.
    first = (tokens.groupBy("path", F.when(F.col("kind") == "error", "").otherwise(F.col("name")).alias("function_name"))
             .agg(F.min_by(F.struct("kind", "name", "code"), F.struct("level", "seq")).alias("t")))
    failed = first.where(F.col("function_name") == "").select("path", F.col("t.name").alias("__error"))
    known = wanted.select("path").distinct().withColumn("__read", F.lit(True))
    out = (req.join(first.where(F.col("function_name") != "").select("path", "function_name", "t.code"), ["path", "function_name"], "left")
           .join(failed, "path", "left").join(known, "path", "left"))
    text = (F.when(~is_safe_path("path"), F.lit(UNSAFE_ERROR))
            .when(F.col("__read").isNull(), F.concat(F.lit(FUNCTION_ERROR + "[Errno 2] No such file or directory: '"), "path", F.lit("'")))
            .when(F.col("__error").isNotNull(), F.concat(F.lit(FUNCTION_ERROR), "__error"))
            .otherwise(F.concat(F.lit("Function '"), F.col("function_name"), F.lit("' not found in "), F.col("path"))))
    return out.select("path", "function_name", F.col("code").isNotNull().alias("found"), F.coalesce("code", text).alias("code"))


def docstring_coverage(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """U4: per file, functions (all depths, sync and async) and how many lack
    a docstring (an empty docstring counts as missing)."""
    fns = extract_functions(files, path_col, content_col, with_code=False)
    agg = fns.groupBy("path").agg(F.count("*").alias("n_functions"),
                                  F.count_if(~F.col("has_docstring")).alias("n_missing"))
    return agg.withColumn("missing_ratio", F.col("n_missing") / F.col("n_functions"))


def extract_declared(manifests: DataFrame, repo_col: str = "repo_id", text_col: str = "manifest") -> DataFrame:
    """Normalized names declared in a project manifest: the first
    ``dependencies = [ ... ]`` block (double- and single-quoted items) and
    the first ``dev = [ ... ]`` block (double-quoted items only).  The block
    ends at the first ``]``.  All native expressions."""
    m = F.col(text_col)
    deps = F.regexp_extract(m, r"(?s)dependencies = \[(.*?)\]", 1)
    has_deps = m.rlike(r"(?s)dependencies = \[(.*?)\]")
    dev = F.regexp_extract(m, r"(?s)dev = \[(.*?)\]", 1)
    has_dev = m.rlike(r"(?s)dev = \[(.*?)\]")
    empty = F.array().cast("array<string>")
    items = F.concat(
        F.when(has_deps, F.regexp_extract_all(deps, F.lit(r'"([^"]+)"'), F.lit(1))).otherwise(empty),
        F.when(has_deps, F.regexp_extract_all(deps, F.lit(r"'([^']+)'"), F.lit(1))).otherwise(empty),
        F.when(has_dev, F.regexp_extract_all(dev, F.lit(r'"([^"]+)"'), F.lit(1))).otherwise(empty))
    raw = manifests.select(F.col(repo_col).alias("repo"), F.explode(items).alias("item"))
    name = requirement_name("item")
    return (raw.select("repo", normalize_name(name, strip_extras=False).alias("name"))
            .where(F.col("name").isNotNull()).distinct())


def extract_project_name(manifests: DataFrame, repo_col: str = "repo_id", text_col: str = "manifest") -> DataFrame:
    """The project's own (normalized) name from a manifest's first
    ``name = "..."`` line: ``repo, name``."""
    n = F.regexp_extract(F.col(text_col), r"(?m)^name\s*=\s*[\"']([^\"']+)[\"']", 1)
    return (manifests.select(F.col(repo_col).alias("repo"), normalize_name(n, strip_extras=False).alias("name"))
            .where(F.col("name") != ""))
