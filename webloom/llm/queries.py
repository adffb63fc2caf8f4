"""The queries of this subpackage, and their SQL where DuckDB can express them on whole tables."""

from __future__ import annotations

from . import decontaminate, langid, minhash, mixing, mtree, quality, substring, toxicity, urlfilter, warc

QUERIES = {
    "op1_warc_dictionary": warc.query,
    "op2_language_backoff": langid.query,
    "op3_quality_resampling": quality.query,
    "op4_mix_systematic": mixing.query,
    "op5_url_link_graph": urlfilter.query,
    "op6_decontaminate_positional": decontaminate.query,
    "op7_top_k_mtree": mtree.query,
    "op8_toxicity_subword": toxicity.query,
    "op9_near_dup_min_max": minhash.query,
    "op10_substring_super_kmer": substring.query,
}

ORACLE_SQL = {
    "op1_warc_dictionary": warc.ORACLE,
    "op4_mix_systematic": mixing.ORACLE,
    "op5_url_link_graph": urlfilter.ORACLE,
    "op6_decontaminate_positional": decontaminate.ORACLE,
    "op7_top_k_mtree": mtree.ORACLE,
    "op9_near_dup_min_max": minhash.ORACLE,
    "op10_substring_super_kmer": substring.ORACLE,
}
