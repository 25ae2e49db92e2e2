"""Imports every module that registers a query."""

from __future__ import annotations

from trafficlens.llm import best_fit, bloom_lm, chat_format, decontaminate, license_scan, minhash, mixing, quality_rules, secret_scan, toxicity, vector_codes, warc, whitening  # noqa: F401
from trafficlens.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
