"""All queries of the library outside the optional subpackages, by name."""

from __future__ import annotations

from cairnlake.plans import analytics, feed, operations, pipeline, relational, streams, workload

MODULES = (pipeline, analytics, feed, operations, relational, streams, workload)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = feed.search_many
