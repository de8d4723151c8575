"""All registered queries of the engine and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("graph", "text", "changes", "records", "planning", "finding", "entries", "quality")


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in importlib.import_module(f"{__package__}.{m}").Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in importlib.import_module(f"{__package__}.{m}").S.items()}
