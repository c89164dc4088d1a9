"""Named queries over the given tables, each with the SQL that checks it."""

from postloom.registry import learning, neighbours, reports, tables, texts  # noqa: F401
from postloom.registry.base import ORACLES, QUERIES  # noqa: F401
