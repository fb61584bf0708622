"""Registered queries and their SQL twins."""

from refledger.plans.queries import batches, evidence, io, joins, lists, rows, streams  # noqa: F401
from refledger.plans.queries.base import ORACLES, QUERIES  # noqa: F401
