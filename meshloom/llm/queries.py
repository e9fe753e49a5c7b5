"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import decontaminate, linededup, lm, ngram_join, packing, pii, quality, toxicity, urlfilter, warc

QUERIES = {
    "op3_quality_rules": quality.op3_quality_rules,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op2_packing": packing.op2_packing,
    "op4_pii": pii.op4_pii,
    "op10_toxicity": toxicity.op10_toxicity,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op7_url_filters": urlfilter.op7_url_filters,
    "op6_warc": warc.op6_warc,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op6_warc": warc.ORACLE,
    "op3_quality_rules": quality.ORACLE,
    "op5_line_dedup": linededup.ORACLE,
    "op7_url_filters": urlfilter.ORACLE,
    "op9_benchmark_decontamination": decontaminate.ORACLE,
}
