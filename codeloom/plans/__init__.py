"""The service facade, and the registry of queries, which importing any part of this package fills."""

from codeloom.plans import catalog  # noqa: F401
