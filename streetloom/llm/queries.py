"""The queries of this subpackage, by name, and their SQL."""

from . import sql
from .bpe import op1_byte_bpe
from .clusters import op12_drake_clusters
from .mixing import op10_pfair_mix
from .neardup import op7_lattice_neardup
from .ngram_join import op6_ngram_join
from .quality import op5_quality
from .secrets import op3_secret_scan
from .substrings import op8_suffix_dedup
from .token_counts import op2_token_counts
from .topk import op4_cover_topk
from .trie import op13_prefix_trie
from .windows import op9_window_dedup
from .wrappers import op11_html_wrapper


def queries():
    ops = (op1_byte_bpe, op2_token_counts, op3_secret_scan, op4_cover_topk, op5_quality, op6_ngram_join, op7_lattice_neardup, op8_suffix_dedup, op9_window_dedup, op10_pfair_mix, op11_html_wrapper, op12_drake_clusters, op13_prefix_trie)
    return {f.__name__: f for f in ops}


def oracle_sql():
    return {
        "op4_cover_topk": sql.OP4_COVER_TOPK,
        "op6_ngram_join": sql.OP6_NGRAM_JOIN,
        "op7_lattice_neardup": sql.OP7_LATTICE_NEARDUP,
        "op8_suffix_dedup": sql.OP8_SUFFIX_DEDUP,
        "op9_window_dedup": sql.OP9_WINDOW_DEDUP,
        "op12_drake_clusters": sql.OP12_DRAKE_CLUSTERS,
        "op13_prefix_trie": sql.OP13_PREFIX_TRIE,
    }
