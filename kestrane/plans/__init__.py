"""Plans over the domain model, and the registered queries: importing the package registers them all."""

from . import analytics, files, ingest, loads, read_api, relational  # noqa: F401
