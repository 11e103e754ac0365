"""Registered jobs over the driver tables; importing this package registers them."""

from . import compilation, context, ingest, maintenance, streams, upkeep

__all__ = ["context", "ingest", "maintenance", "streams", "upkeep"]
