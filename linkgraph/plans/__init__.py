"""Registered queries and the SQL that gives the same rows."""

from . import cascades, code, entities, files, forests, hierarchy, linking, matching, members, reports, transfers  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
