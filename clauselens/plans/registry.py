"""Registered queries of the engine and their SQL twins."""

from __future__ import annotations

from . import evidence, language, measuring, modules, scoring, structure  # noqa: F401
from .base import ORACLE, QUERIES


def flagship(spark, sf_dir):
    return QUERIES["doc_idf_rank"](spark, sf_dir)


__all__ = ["ORACLE", "QUERIES", "flagship"]
