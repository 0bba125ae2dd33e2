"""keylink: finds how the tables of a database relate, by looking at their data."""

from keylink.params import Params, resolve_params
from keylink.plans.discover import discover, discover_many
from keylink.sources.catalog import Source, files_source, spark_catalog_source
from keylink.sources.workspace import Workspace

__all__ = [
    "Params",
    "Source",
    "Workspace",
    "discover",
    "discover_many",
    "files_source",
    "resolve_params",
    "spark_catalog_source",
]
