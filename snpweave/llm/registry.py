"""Queries of this subpackage, by name, and SQL where it can express them."""

from __future__ import annotations

from snpweave.llm.embedding_dedup import OP3_SQL, op3_embedding_dedup
from snpweave.llm.fingerprint import op5_fingerprint
from snpweave.llm.lexical_search import OP12_SQL, op12_lexical_search
from snpweave.llm.lm_scoring import op10_lm_scoring
from snpweave.llm.mixing import OP11_SQL, op11_mixing
from snpweave.llm.ngram_join import OP9_SQL, op9_ngram_join
from snpweave.llm.packing import op4_packing
from snpweave.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from snpweave.llm.quality import op8_quality_classifier
from snpweave.llm.secrets import op7_secret_scan
from snpweave.llm.sentencepiece_lattice import op1_sentencepiece
from snpweave.llm.suffix_dedup import op6_suffix_dedup
from snpweave.llm.token_counts import op2_token_counts

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_counts": op2_token_counts,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_packing": op4_packing,
    "op5_fingerprint": op5_fingerprint,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_ngram_join": op9_ngram_join,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_mixing": op11_mixing,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op3_embedding_dedup": OP3_SQL, "op9_ngram_join": OP9_SQL, "op11_mixing": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_prefix_trie": OP13_SQL}
