"""Operators as registered queries."""

from . import composed, imports, queries, reviewed, scalars, screens, stored  # noqa: F401
