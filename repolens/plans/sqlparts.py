"""DuckDB SQL fragments shared by several oracle statements."""

import sys

from ..functions.names import SELF_NAMES, STDLIB_COMMON, TOOL_ONLY


def sql_list(items) -> str:
    return "(" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + ")"


def license_sql(lic: str, cls_txt: str, name: str) -> str:
    """Resolved license (same rule as ``functions.names.resolve_license``)."""
    first = f"list_filter(string_split(coalesce({cls_txt}, ''), '|'), lambda x: contains(x, 'License ::'))[1]"
    last = f"string_split({first}, ' :: ')[-1]"
    bad = "('unknown', 'n/a', '')"
    return (f"CASE WHEN {lic} IS NOT NULL AND lower({lic}) NOT IN {bad} THEN {lic} "
            f"WHEN {first} IS NOT NULL AND lower({last}) NOT IN {bad} THEN {last} "
            f"WHEN lower({name}) = 'pytest' THEN 'MIT' ELSE 'Unknown' END")


def norm_sql(x: str) -> str:
    return f"lower(replace({x}, '_', '-'))"


STDLIB_SQL = sql_list(STDLIB_COMMON)
TOOL_ONLY_SQL = sql_list(TOOL_ONLY)
SELF_SQL = sql_list(SELF_NAMES)
# Names dropped by reference classification: the common list plus the
# interpreter's built-in modules.
STDLIB_CLASSIFY_SQL = sql_list(STDLIB_COMMON + sorted(sys.builtin_module_names))
