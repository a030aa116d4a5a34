"""Registered queries; importing this package fills the registry."""

from tallyforge.plans import answer_queries, archive_queries, economics_queries, evidence_queries, graph_queries, inventory_queries, invariant_queries, linkage_queries, median_queries, processed_queries, proposal_queries, region_queries, retrieval_queries, session_queries, templates, text_queries, traversal_queries  # noqa: F401
