"""Relational operators: DataFrames in, DataFrames out."""

from lexvane.operators.cells import fit_cells, probes_for, search_cells, write_cells
from lexvane.operators.evaluation import evaluate, latency_report, metrics, promotion
from lexvane.operators.evidence import answer, grade
from lexvane.operators.retrieval import cross_encoder, dense, deterministic, fuse, hybrid, indexed, lexical, nearest, reranker
from lexvane.operators.security import access_reason, checked_contract, request_counts, scope_reason

__all__ = [
    "access_reason", "answer", "checked_contract", "cross_encoder", "dense", "deterministic", "evaluate", "fit_cells", "fuse", "grade", "hybrid", "indexed",
    "latency_report", "lexical", "metrics", "nearest", "probes_for", "promotion", "request_counts", "reranker", "scope_reason", "search_cells", "write_cells",
]
