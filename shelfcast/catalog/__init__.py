"""The queries this library answers on the test tables."""

from shelfcast.catalog import daily, hourly, learned  # noqa: F401  (registering is their import effect)
from shelfcast.catalog.registry import ENTRIES

__all__ = ["ENTRIES"]
