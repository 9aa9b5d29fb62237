"""Importing this module registers the queries of the subpackage."""

from notewright.llm import op01_toxicity, op02_bpe, op03_ngram_join, op04_langid, op05_suffix_dedup, op06_warc, op07_decontamination, op08_secrets, op09_token_counts, op10_neighbours, op11_infill, op12_phrase_dedup, op13_hard_negatives  # noqa: F401
from notewright.llm.registry import ORACLES, QUERIES  # noqa: F401
