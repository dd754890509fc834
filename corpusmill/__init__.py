"""Corpus analytics as PySpark DataFrame operators."""

from corpusmill.settings import Settings

__all__ = ["Settings"]
