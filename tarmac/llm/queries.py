"""The queries of the training-data operators and their SQL; __spark_entry__.py adds them."""

from __future__ import annotations

from .bpe import op7_bpe
from .decontamination import op4_decontaminate
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .hnsw import op5_ann
from .html_text import op8_html_text
from .lm_scoring import OP1_SQL, op1_lm_score
from .near_dedup import op9_near_dup
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .secrets import op3_secrets
from .sharding import op10_shard_ring
from .suffix_repeats import op11_suffix_repeats
from .toxicity import op2_toxicity
from .warc import op6_warc

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_decontaminate": op4_decontaminate,
    "op5_ann": op5_ann,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_html_text": op8_html_text,
    "op9_near_dup": op9_near_dup,
    "op10_shard_ring": op10_shard_ring,
    "op11_suffix_repeats": op11_suffix_repeats,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op1_lm_score": OP1_SQL, "op12_prefix_trie": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
