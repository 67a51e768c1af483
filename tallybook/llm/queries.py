"""One query for each operator of this subpackage, over its whole table; SQL where SQL can express it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm.bpe import op2_bpe
from tallybook.llm.centroids import OP11_SQL, op11_centroids
from tallybook.llm.chat import OP9_SQL, op9_chat
from tallybook.llm.embedding_dedup import op8_embedding_dedup
from tallybook.llm.fingerprints import op1_fingerprints
from tallybook.llm.licences import op10_licences
from tallybook.llm.mixing import op4_mixing
from tallybook.llm.quality import OP13_SQL, op13_quality
from tallybook.llm.ranking import OP12_SQL, op12_ranked_search
from tallybook.llm.simhash import op7_simhash
from tallybook.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from tallybook.llm.suffix_dedup import op5_suffix_dedup
from tallybook.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_bpe": op2_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_chat": op9_chat,
    "op10_licences": op10_licences,
    "op11_centroids": op11_centroids,
    "op12_ranked_search": op12_ranked_search,
    "op13_quality": op13_quality,
}
SQL: dict[str, str] = {"op3_substring_dedup": OP3_SQL, "op9_chat": OP9_SQL, "op11_centroids": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_quality": OP13_SQL}
