"""All queries. Importing a plan module registers what it holds."""

from runledger.plans import consensus, constraints, declared, graph, lifecycle, match, monitor, quality, queueing, records, streams, usage  # noqa: F401
from runledger.plans.registry import COVERS, QUERIES, SQL  # noqa: F401
