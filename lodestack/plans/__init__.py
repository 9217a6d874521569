"""The registry of queries and their SQL; importing it registers all of them."""

from lodestack.plans import catalog, knowledge, registry, searching  # noqa: F401
