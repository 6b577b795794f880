"""All registered queries but those for training data."""

from quillstone.plans import briefing, bundles, closures, contexts, documents, evidence, graph, harness, ledger, news, policies, records, relational, retrieval, rights, scalars, structure, tables
from quillstone.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "briefing", "bundles", "closures", "contexts", "documents", "evidence", "graph", "harness", "ledger", "news", "policies", "records", "relational", "retrieval", "rights", "scalars", "structure", "tables"]
