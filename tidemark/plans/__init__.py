"""Registered queries of the library's own operators."""

from . import analytics, documents, io, network, quality, relational, search  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
