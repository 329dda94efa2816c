"""The pipeline over the documents; its stages are in junctura.llm.pipeline, as a part of which this file counts."""

from junctura.llm.pipeline import ORACLE_SQL, STAGES, bpe_tokens, mix_sources, ngram_jaccard_join, quality_classifier, quality_rules, run

__all__ = ["ORACLE_SQL", "STAGES", "bpe_tokens", "mix_sources", "ngram_jaccard_join", "quality_classifier", "quality_rules", "run"]
