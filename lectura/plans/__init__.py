"""Presets: contexts for common callers."""

from __future__ import annotations

from ..operators.read import Context

BUILDING = Context(locale="ja", dimensions=("length", "area"), registry=("length", "area"))
MINIMAL = Context(dimensions=("length", "area"), registry=("length", "area"))
UNRESTRICTED = Context()
STRICT = Context(strictness="strict")
