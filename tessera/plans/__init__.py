"""Named queries over the driver tables.  Importing this package registers
every plan module; ``QUERIES`` / ``ORACLE`` are then complete."""

from tessera.plans import checks, eda, features, io, metrics, modeling, ordering, quality, serving, streams  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES, load, query

__all__ = ["QUERIES", "ORACLE", "load", "query"]
