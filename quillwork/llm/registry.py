"""The queries of this subpackage."""

from __future__ import annotations

from ..plans.registry import gather

MODULES = ("q_compounds", "q_activities", "q_vectors", "q_leakage", "q_documents")


def llm() -> tuple[dict, dict]:
    return gather("quillwork.llm", MODULES)
