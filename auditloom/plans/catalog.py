"""Imports every module that registers queries."""

from auditloom.plans import federated_queries, graph_queries, network_queries, privacy_queries, proof_queries, sequence_queries, stream_queries, tenant_queries, text_queries  # noqa: F401
