"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_align_tokenizers
from .chat_format import OP4_SQL, op4_chat_format
from .decontaminate import OP7_SQL, op7_decontaminate
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .jaccard_join import op8_jaccard_join
from .jaccard_sql import OP8_SQL
from .line_quality import op10_quality_crf
from .minimax_shards import op6_minimax_shards
from .mix_sources import op5_mix_sources
from .packing import op12_pack_documents
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .secrets import op3_secret_scan
from .token_files import op1_token_binary
from .toxicity import op2_toxicity_crf


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_binary": op1_token_binary,
        "op2_toxicity_crf": op2_toxicity_crf,
        "op3_secret_scan": op3_secret_scan,
        "op4_chat_format": op4_chat_format,
        "op5_mix_sources": op5_mix_sources,
        "op6_minimax_shards": op6_minimax_shards,
        "op7_decontaminate": op7_decontaminate,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_quality_crf": op10_quality_crf,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_pack_documents": op12_pack_documents,
        "op13_align_tokenizers": op13_align_tokenizers,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op7_decontaminate": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL}
