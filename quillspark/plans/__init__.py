"""Registered queries over the tables, by topic."""

from quillspark.plans import content, files, formats, glyphs, images, layout, optimize, pages, sheets, slides, stamp, text, usage, word  # noqa: F401
from quillspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
