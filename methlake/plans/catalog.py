"""Imports every module that registers queries."""

from methlake.plans import queries_files, queries_model, queries_reads, queries_text, queries_training, queries_tree  # noqa: F401
from methlake.plans.registry import QUERIES, SQL  # noqa: F401
