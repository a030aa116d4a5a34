"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallyforge.llm import bpe, collocations, exact_dedup, hmm, langid, line_dedup, media, ngram_join, packing, pii, prefix_bpe, quality, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
        "op3_hmm": hmm.op3_hmm,
        "op4_language_id": langid.op4_language_id,
        "op5_packing": packing.op5_packing,
        "op6_bpe": bpe.op6_bpe,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_quality": quality.op8_quality,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_media_columns": media.op10_media_columns,
        "op11_collocations": collocations.op11_collocations,
        "op12_prefix_bpe": prefix_bpe.op12_prefix_bpe,
        "op13_whitening": whitening.op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": exact_dedup.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL}
