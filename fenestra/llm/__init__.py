"""Operators of a training-data pipeline, and their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fenestra.llm.align import op11_align
from fenestra.llm.bpe import op8_bpe
from fenestra.llm.class_lm import op1_class_lm
from fenestra.llm.jaccard_join import OP9_SQL, op9_jaccard_join
from fenestra.llm.media import op7_wav_fingerprints
from fenestra.llm.mixing import OP10_SQL, op10_mixing
from fenestra.llm.phrases import OP13_SQL, op13_phrases
from fenestra.llm.pii import op2_pii
from fenestra.llm.quality_rules import ABLATIONS_SQL, OP5_SQL, op5_quality_rules, quality_ablations
from fenestra.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from fenestra.llm.toxicity import op3_toxicity
from fenestra.llm.url_filter import op12_url_filter
from fenestra.llm.word_pieces import op6_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_class_lm, op2_pii, op3_toxicity, op4_substring_dedup, op5_quality_rules, op6_token_counts, op7_wav_fingerprints, op8_bpe, op9_jaccard_join, op10_mixing, op11_align, op12_url_filter, op13_phrases, quality_ablations)}

ORACLES: dict[str, str] = {"op4_substring_dedup": OP4_SQL, "op5_quality_rules": OP5_SQL, "op9_jaccard_join": OP9_SQL, "op10_mixing": OP10_SQL, "op13_phrases": OP13_SQL, "quality_ablations": ABLATIONS_SQL}
