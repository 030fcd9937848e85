"""The queries of this subpackage, as the driver's entry adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semaspark.llm import curve, divergence, htmltext, linededup, maxent, mixing, neardup, packing, pii, quality, topk, toxicity, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": topk.op1_topk,
    "op2_mixing": mixing.op2_mixing,
    "op3_pii": pii.op3_pii,
    "op4_near_dedup": neardup.op4_near_dedup,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_maxent": maxent.op6_maxent,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_packing": packing.op9_packing,
    "op10_html": htmltext.op10_html,
    "op11_trie": trie.op11_trie,
    "op12_hilbert": curve.op12_hilbert,
    "op13_divergence": divergence.op13_divergence,
}
ORACLES: dict[str, str] = {
    "op1_topk": topk.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op11_trie": trie.OP11_SQL,
    "op12_hilbert": curve.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
