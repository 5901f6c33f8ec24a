"""Imports every module that registers a query."""

from __future__ import annotations

from . import bit_sliced, decontaminate, filter_audit, jaccard, licences, lines, neardup_vectors, packing, prefix_trie, quality, substrings, tokenids, warc  # noqa: F401
from .registry import CHECKS, QUERIES  # noqa: F401
