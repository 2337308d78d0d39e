"""The registered queries: importing this package fills registry.QUERIES and registry.SQL."""

from . import history, identity, more, notifications, offers, places, quality, streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
