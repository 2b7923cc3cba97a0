"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .collocations import OP12_SQL, op12_collocations
from .divergence import OP11_SQL, op11_divergence
from .embedding_dedup import OP8_SQL, op8_embedding_dedup
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .language_id import op13_language_id
from .ngram_jaccard import OP5_SQL, op5_ngram_jaccard
from .packing import op1_best_fit_packing
from .quality import op7_quality
from .suffix_dedup import op6_suffix_dedup
from .token_files import op2_token_files
from .url_filter import OP9_SQL, op9_url_filter
from .warc import op10_warc

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_files": op2_token_files,
    "op3_bpe": op3_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_warc": op10_warc,
    "op11_divergence": op11_divergence,
    "op12_collocations": op12_collocations,
    "op13_language_id": op13_language_id,
}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op8_embedding_dedup": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_divergence": OP11_SQL, "op12_collocations": OP12_SQL}
