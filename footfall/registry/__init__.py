"""Registered queries over the driver tables, one module per operator group."""

from importlib import import_module

GROUPS = (
    "sources", "catalog", "alignment", "filters", "metrics", "orientation", "raster", "patches", "clusters", "reports",
)


def load_all() -> None:
    for group in GROUPS:
        import_module(f"footfall.registry.{group}")
