"""SQL surface for the source extractors: Python UDTFs.

``register_udtfs(spark)`` makes these callable from SQL::

    SELECT f.path, t.ref FROM files f, LATERAL extract_refs(f.content) t
    SELECT f.path, t.* FROM files f, LATERAL extract_structure(f.content) t
    SELECT f.path, t.* FROM files f, LATERAL extract_functions(f.content) t

They emit token rows only (Arrow-batched); distinct, joins and roll-ups stay
in SQL.  The DataFrame operators in ``repolens.operators.extract`` share the
same row logic.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.extract import STRUCTURE_ERROR, token_rows


@udtf(returnType="ref string", useArrow=True)
class ExtractRefs:
    def eval(self, content: str):
        for ref in sorted({row[4] for row in token_rows(content, False)} - {None}):
            yield (ref,)


@udtf(returnType="pos int, kind string, name string, members array<string>, lineno int", useArrow=True)
class ExtractStructure:
    def eval(self, content: str):
        pos = 0
        for level, _, kind, name, _, members, _, lineno, _, _ in token_rows(content, False):
            if kind == "error":
                yield 0, kind, STRUCTURE_ERROR + name, None, None
            elif level == 1 and kind != "async":
                yield pos, kind, name, members, lineno
                pos += 1


@udtf(returnType="level int, seq int, name string, is_async boolean, lineno int, has_docstring boolean, code string",
      useArrow=True)
class ExtractFunctions:
    def eval(self, content: str, with_code: bool = True):
        for level, seq, kind, name, _, _, _, lineno, doc, code in token_rows(content, with_code):
            if kind in ("function", "async"):
                yield level, seq, name, kind == "async", lineno, doc, code


def register_udtfs(spark: SparkSession) -> None:
    spark.udtf.register("extract_refs", ExtractRefs)
    spark.udtf.register("extract_structure", ExtractStructure)
    spark.udtf.register("extract_functions", ExtractFunctions)
