"""All queries of the subpackage, with their SQL."""

from __future__ import annotations

from ledgerloom.llm import q_groups, q_pii, q_sequences, q_sets, q_texts

QUERIES = q_groups.QUERIES | q_pii.QUERIES | q_sequences.QUERIES | q_sets.QUERIES | q_texts.QUERIES
ORACLES: dict[str, str] = q_groups.ORACLES | q_sets.ORACLES | q_texts.ORACLES
