"""The queries of the training-data operators and their SQL."""

from facetgraph.llm.alignment import op12_align_tokenizers
from facetgraph.llm.html_text import op4_html_text
from facetgraph.llm.language import op13_language_id
from facetgraph.llm.line_dedup import OP7_SQL, op7_line_dedup
from facetgraph.llm.mixing import OP1_SQL, op1_mix_sources
from facetgraph.llm.near_dup import OP9_SQL, op9_near_duplicates
from facetgraph.llm.packing import op5_pack_documents
from facetgraph.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from facetgraph.llm.quality import OP2_SQL, op2_quality_rules
from facetgraph.llm.secrets import OP6_SQL, op6_secret_scans
from facetgraph.llm.sharding import OP8_SQL, op8_shard_records
from facetgraph.llm.top_k import OP3_SQL, op3_top_k_search
from facetgraph.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_rules": op2_quality_rules,
    "op3_top_k_search": op3_top_k_search,
    "op4_html_text": op4_html_text,
    "op5_pack_documents": op5_pack_documents,
    "op6_secret_scans": op6_secret_scans,
    "op7_line_dedup": op7_line_dedup,
    "op8_shard_records": op8_shard_records,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_align_tokenizers": op12_align_tokenizers,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL = {
    "op1_mix_sources": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op3_top_k_search": OP3_SQL,
    "op6_secret_scans": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_shard_records": OP8_SQL,
    "op9_near_duplicates": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
}
