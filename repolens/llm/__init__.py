"""Operators for training-data pipelines (URL rules, chat templates, substring
and near-duplicate removal, mixing, language ID, sketches, tokenization,
nearest neighbours, personal data).  Nothing outside this subpackage imports
it; ``QUERIES`` and ``ORACLE`` are its registered queries."""

from .queries import ORACLE, QUERIES  # noqa: F401
