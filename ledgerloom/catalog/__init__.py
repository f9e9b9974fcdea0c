"""Every registered query; importing a module registers its queries."""

from importlib import import_module

_MODULES = ["scalars", "series", "backfill", "checks", "reshape", "appends", "layout", "align", "diffs", "exports", "streams"]

for _name in _MODULES:
    import_module(f"{__name__}.{_name}")

from ledgerloom.catalog.registry import ORACLES, QUERIES, runner  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "runner"]
