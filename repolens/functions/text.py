"""Column expressions over text: safety predicates, truncation, fence
cleaning, prompt templates, previews and mentions.

All of these are built-in Spark expressions (whole-stage codegen, no Python
at run time).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# Fixed values that must equal the reference's behaviour.
# Words that make a shell command unsafe (matched as whole words, case-insensitive).
FORBIDDEN_COMMAND_WORDS = ["env", "printenv", ".env", "export", "set", "unset"]
# Diff truncation limit and the marker appended after the kept prefix.
MAX_DIFF_CHARS = 2000
TRUNCATION_MARKER = "\n... (truncated for brevity)"
# Characters that end a line for Python's str.splitlines().
_LINE_BREAKS = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# Python's str.strip() whitespace: every character for which str.isspace()
# holds (all lie below U+3001).
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
_WS = "[" + "".join(f"\\u{ord(c):04x}" for c in PY_WHITESPACE) + "]"
# Letters, digits and underscore, as Python's Unicode ``\w``.
WORD_CLASS = r"\p{L}\p{N}_"


def py_strip(c) -> Column:
    """Python ``str.strip()`` (Spark's ``trim`` strips spaces only):
    ``btrim`` with the exact whitespace set, no regex."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def is_safe_path(path) -> Column:
    """False when ``.env`` occurs anywhere in the path (file name included)."""
    return ~F.contains(col(path), F.lit(".env"))


def _is_word_char(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def command_word_pattern(words=None) -> str:
    """Whole-word alternation with Python's Unicode ``\\b`` semantics spelled
    out as lookarounds over ``[\\p{L}\\p{N}_]`` (Java's ``\\b`` and ``\\w``
    differ from Python's on non-ASCII text)."""
    words = FORBIDDEN_COMMAND_WORDS if words is None else list(words)
    w = f"[{WORD_CLASS}]"
    alts = []
    for word in words:
        start = f"(?<!{w})" if _is_word_char(word[0]) else f"(?<={w})"
        end = f"(?!{w})" if _is_word_char(word[-1]) else f"(?={w})"
        alts.append(start + re.escape(word) + end)
    return "|".join(alts)


def is_safe_command(text, words=None) -> Column:
    """False when the lower-cased text contains a forbidden whole word."""
    if words is not None and len(list(words)) == 0:
        return F.lit(True)
    return ~F.lower(col(text)).rlike(command_word_pattern(words))


def truncate_text(text, limit: int = MAX_DIFF_CHARS, marker: str = TRUNCATION_MARKER) -> Column:
    """Keep the first ``limit`` characters and add ``marker`` when longer."""
    c = col(text)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def split_lines(text) -> Column:
    """Python ``str.splitlines()`` for text that does not end in a line break."""
    return F.split(col(text), _LINE_BREAKS)


def clean_fenced_text(text) -> Column:
    """Strip; when the text starts and ends with a triple backtick, drop its
    first and last line and strip again.  Null and empty stay unchanged."""
    c = col(text)
    s = py_strip(c)
    lines = split_lines(s)
    inner = F.when(F.size(lines) > 2, F.slice(lines, 2, F.size(lines) - 2)).otherwise(F.array().cast("array<string>"))
    fenced = s.startswith("```") & s.endswith("```")
    return (F.when(c.isNull() | (c == ""), c)
            .when(fenced, py_strip(F.array_join(inner, "\n")))
            .otherwise(s))


def sanitize_docstring(text) -> Column:
    """Remove every triple double quote and every single quote."""
    return F.replace(F.replace(col(text), F.lit('"""'), F.lit("")), F.lit("'"), F.lit(""))


def render_template(template: str, **values) -> Column:
    """Fill ``{name}`` placeholders of a literal template with columns."""
    out = F.lit(template)
    for name, value in values.items():
        v = value if isinstance(value, Column) else F.col(value)
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("None")))
    return out


def history_preview(role, content, tool_calls=None) -> Column:
    """``[role]: <first 50 chars>...``; ``<n tool calls>`` when there is no
    content but tool calls exist; empty preview otherwise."""
    c = F.coalesce(col(content), F.lit(""))
    preview = F.when(c != "", F.concat(F.substring(c, 1, 50), F.lit("..."))).otherwise(F.lit(""))
    if tool_calls is not None:
        n = F.size(col(tool_calls))
        preview = F.when((c == "") & col(tool_calls).isNotNull() & (n > 0),
                         F.concat(F.lit("<"), n.cast("string"), F.lit(" tool calls>"))).otherwise(preview)
    return F.concat(F.lit("["), F.coalesce(col(role), F.lit("unknown")), F.lit("]: "), preview)


def mention_pattern() -> str:
    return rf"@([{WORD_CLASS}./-]+)"


def extract_mentions(text) -> Column:
    """Array of every ``@name`` token's name, in order of appearance."""
    return F.regexp_extract_all(col(text), F.lit(mention_pattern()), F.lit(1))
