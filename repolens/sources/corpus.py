"""File-corpus sources and path operators.

A corpus is a DataFrame ``(repo, path, content)``; ``read_corpus`` builds one
from a directory tree, hidden names included (name filters are pushed into the
listing).  Path rules are native string/array
expressions, so they run inside whole-stage codegen and push nothing through
Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._util import col
from ..functions.text import is_safe_path
from .files import list_files, qualified, read_files

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
#
# Default scan filters: file-name endings and whole file names to skip.
DEFAULT_IGNORE_EXTENSIONS = [".pycache", ".pyc", ".pyo"]
DEFAULT_IGNORE_FILES = ["__init__.py"]
# The tool's own state directory (pruned by the walkers like ``.git``).
TOOL_STATE_DIR = ".repolens"
# Directory names pruned by each walker.
AUDIT_IGNORE_DIRS = [".venv", "venv", "env", "site-packages", "node_modules", ".git", "__pycache__",
                     TOOL_STATE_DIR, "conda-meta", "lib", "bin", "include", "share", "pkgs"]
SOURCE_FINDER_IGNORE_DIRS = [".git", "__pycache__", "venv", ".venv", "node_modules"]
OVERVIEW_IGNORE_DIRS = [".git", "__pycache__", "venv", ".venv", "node_modules", ".pytest_cache"]
MENTION_IGNORE_DIRS = [".git", "__pycache__", "venv", ".venv", "node_modules", TOOL_STATE_DIR, ".pytest_cache",
                       ".idea", ".vscode", "build", ".github"]
MENTION_IGNORE_EXTENSIONS = [".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe", ".DS_Store", ".o", ".bin"]
# Error texts of the file reader.
DECODE_ERROR = "not valid UTF-8"
UNSAFE_READ_ERROR = "Error: Access to .env files is strictly prohibited for security reasons."
# ---------------------------------------------------------------------------

PROFILES = {
    "audit": AUDIT_IGNORE_DIRS,
    "source_finder": SOURCE_FINDER_IGNORE_DIRS,
    "overview": OVERVIEW_IGNORE_DIRS,
    "mention_index": MENTION_IGNORE_DIRS,
}


def read_corpus(spark: SparkSession, root: str, glob: str | None = None, skip_dirs=(), names: str = "all") -> DataFrame:
    """Every file below ``root`` as ``(repo, path, content, error)``.

    ``repo`` is the first directory below ``root``; ``path`` is relative to
    the repo.  A file that is not UTF-8 or cannot be read has null content and
    an ``error``.  ``glob`` (e.g. ``*.py``) and ``skip_dirs`` (directory names
    not to enter) work while directories are listed, before any bytes are read.

    Names that begin with ``_`` or ``.`` are read like others
    (``sources.files``).  ``names="visible"`` takes Spark's ``binaryFile``
    listing instead, which leaves them out but reads every file system that
    Spark reads.
    """
    if names == "visible":
        r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob:
            r = r.option("pathGlobFilter", glob)
        # The root as the file system itself writes it is a prefix of every path.
        base = qualified(spark, root) + "/"
        rel = F.when(F.col("path").startswith(base), F.substring(F.col("path"), len(base) + 1, 1 << 30)).otherwise(F.col("path"))
        text = F.col("content").cast("string")
        valid = F.is_valid_utf8(text)
        found = r.load(root).select(rel.alias("path"), F.when(valid, text).alias("content"), F.when(~valid, F.lit(DECODE_ERROR)).alias("error"))
        for d in skip_dirs:
            found = found.where(~F.array_contains(dir_components("path"), d))
    else:
        found = read_files(spark, root, list_files(spark, root, glob, skip_dirs), DECODE_ERROR)
    return found.select(F.substring_index("path", "/", 1).alias("repo"), F.regexp_replace("path", r"^[^/]*/", "").alias("path"), "content", "error")


def file_name(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def dir_components(path) -> Column:
    """Directory components of a relative path (file name excluded)."""
    parts = F.split(col(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def scan_filter(path, ignore_extensions=None, ignore_files=None) -> Column:
    """S1 predicate: keep files whose name has none of the ignored endings and
    is not an ignored name; an empty list keeps all."""
    exts = DEFAULT_IGNORE_EXTENSIONS if ignore_extensions is None else list(ignore_extensions)
    names = DEFAULT_IGNORE_FILES if ignore_files is None else list(ignore_files)
    name = file_name(path)
    keep = F.lit(True)
    for e in exts:
        keep = keep & ~name.endswith(e)
    if names:
        keep = keep & ~name.isin(*names)
    return keep


def corpus_scan(files: DataFrame, path_col: str = "path", ignore_extensions=None, ignore_files=None) -> DataFrame:
    """The corpus without ignored extensions and file names."""
    return files.where(scan_filter(path_col, ignore_extensions, ignore_files))


def relative_path(path, repo, path_has_repo: bool = True) -> Column:
    """Path relative to the repository root.  ``path_has_repo`` says whether
    paths begin with ``repo/`` (then it is removed) or are relative already
    (``read_corpus``); a directory that is named like the repository is told
    from the prefix only by this argument."""
    p, r = col(path), col(repo)
    if not path_has_repo:
        return p
    return F.when(p.startswith(F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, 1 << 30)).otherwise(p)


def no_ignored_dir(rel_path, ignore_dirs, drop_env_dirs: bool = False) -> Column:
    dirs = dir_components(rel_path)
    keep = ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in ignore_dirs]))
    # arrays_overlap is null when no overlap exists but an element is null
    keep = F.coalesce(keep, F.lit(True))
    if drop_env_dirs:
        keep = keep & ~F.exists(dirs, lambda d: F.contains(d, F.lit(".env")))
    return keep


def corpus_scan_pruned(files: DataFrame, profile: str = "audit", repo_col: str = "repo",
                       path_col: str = "path", path_has_repo: bool = True) -> DataFrame:
    """Keep files with no ignored directory component (relative to the
    repository root), per walker profile, and add ``rel_path``.

    ``audit``: ``.py`` files that also pass the S1 filter.
    ``source_finder``: ``.py`` files, ``.env`` directories and files dropped.
    ``overview``: ``.py`` files.
    ``mention_index``: every file except the ignored extensions.
    """
    rel = relative_path(path_col, repo_col, path_has_repo)
    df = files.withColumn("rel_path", rel)
    dirs = PROFILES[profile]
    keep = no_ignored_dir("rel_path", dirs, drop_env_dirs=(profile == "source_finder"))
    name = file_name("rel_path")
    if profile == "audit":
        keep = keep & name.endswith(".py") & scan_filter("rel_path")
    elif profile == "source_finder":
        keep = keep & name.endswith(".py") & is_safe_path(name)
    elif profile == "overview":
        keep = keep & name.endswith(".py")
    elif profile == "mention_index":
        # os.path.splitext: extension after the last dot, a leading dot of
        # the name does not start an extension.
        ext = F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1)
        ext = F.when(F.regexp_replace(name, r"^\.+", "").contains("."), ext).otherwise(F.lit(""))
        keep = keep & ~ext.isin(*MENTION_IGNORE_EXTENSIONS)
    else:
        raise ValueError(profile)
    return df.where(keep)


def _ancestors(path) -> Column:
    """All proper directory prefixes of a path: a/b/c.py -> [a, a/b]."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def dir_listing(files: DataFrame, directory: str | None = None, path_col: str = "path") -> DataFrame:
    """S3: immediate children (files and sub-directories) of directories,
    with unsafe (``.env``) names dropped: ``directory, child``.

    With ``directory`` given, only that directory is listed; otherwise every
    directory of the corpus is listed at once (one explode of ancestors plus
    one distinct -- no per-directory jobs).
    """
    p = col(path_col)
    if directory is not None:
        d = directory.rstrip("/")
        sub = files.where(p.startswith(d + "/")).select(
            F.lit(d).alias("directory"),
            F.split(F.substring(p, len(d) + 2, 1 << 30), "/").getItem(0).alias("child"))
    else:
        parts = F.split(p, "/")
        pairs = files.select(F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("i", "_c"), parts.alias("parts"))
        sub = pairs.select(F.array_join(F.slice("parts", 1, F.col("i") + 1), "/").alias("directory"),
                           F.element_at("parts", F.col("i") + 2).alias("child"))
    return sub.where(is_safe_path("child")).distinct()


def project_structure(files: DataFrame, repo_col: str = "repo", path_col: str = "path") -> DataFrame:
    """Per repository, every non-root directory and every ``.py`` file
    below the root, pruning the overview profile's directories (and what is
    below them).  Output ``repo, kind, path`` with paths relative to the root.
    Directories are derived from files, so empty directories do not appear.
    """
    df = files.select(col(repo_col).alias("repo"), relative_path(path_col, repo_col).alias("rel"))
    ignored = F.array(*[F.lit(d) for d in OVERVIEW_IGNORE_DIRS])
    parts = F.split("rel", "/")
    # A directory is listed when the walk reaches it: none of its own
    # components is pruned (what lies below it does not matter).
    dirs = (df.where(F.size(parts) > 1)
            .select("repo", F.explode(_ancestors("rel")).alias("path"))
            .where(~F.coalesce(F.arrays_overlap(F.split("path", "/"), ignored), F.lit(False)))
            .select("repo", F.lit("directory").alias("kind"), "path"))
    py = (df.where(no_ignored_dir("rel", OVERVIEW_IGNORE_DIRS) & F.col("rel").endswith(".py"))
          .select("repo", F.lit("python_file").alias("kind"), F.col("rel").alias("path")))
    return dirs.unionByName(py).distinct()


def read_documents(requests: DataFrame, files: DataFrame, path_col: str = "path",
                   content_col: str = "content") -> DataFrame:
    """Per requested path, its content or an error text (unsafe path,
    missing file) -- never a failed job.  Left join of the request list to
    the corpus on path."""
    f = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("_content"), F.lit(True).alias("_hit"))
    out = requests.select("path").join(f, "path", "left")
    missing = F.concat(F.lit("Error reading file: [Errno 2] No such file or directory: '"), F.col("path"), F.lit("'"))
    text = (F.when(~is_safe_path("path"), F.lit(UNSAFE_READ_ERROR))
            .when(F.col("_hit").isNull(), missing)
            .otherwise(F.col("_content")))
    return out.select("path", text.alias("content"),
                      (is_safe_path("path") & F.col("_hit").isNotNull()).alias("ok"))


CONTEXT_HEADER = "\n\nContext files:\n"


def assemble_context(requests: DataFrame, context_files: DataFrame, files: DataFrame, key_col: str = "request_id",
                     text_col: str = "request", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """S5 (context assembly): append to each request a ``Context files:``
    section with one ``--- path ---`` block per listed file, in list order
    (``context_files``: ``key, pos, path``); a file that cannot be read gets
    an error line instead of its content.  Requests without context files
    are unchanged.  Left join to the corpus plus a two-level ordered fold."""
    from ..operators.ordered import ordered_concat

    f = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("_c"))
    cf = context_files.select(F.col(key_col).alias("_k"), "pos", "path").join(f, "path", "left")
    err = F.concat(F.lit("Error reading: [Errno 2] No such file or directory: '"), F.col("path"), F.lit("'"))
    block = F.concat(F.lit("\n--- "), F.col("path"), F.lit(" ---\n"), F.coalesce(F.col("_c"), err), F.lit("\n"))
    blocks = ordered_concat(cf.select("_k", "pos", block.alias("b")), ["_k"], "pos", "b", out_col="_ctx")
    r = requests.select(F.col(key_col).alias("_k"), F.col(text_col).alias("_t"))
    out = r.join(blocks, "_k", "left")
    text = F.when(F.col("_ctx").isNotNull(), F.concat(F.col("_t"), F.lit(CONTEXT_HEADER), F.col("_ctx"))) \
        .otherwise(F.col("_t"))
    return out.select(F.col("_k").alias(key_col), text.alias(text_col))
