"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .language import op5_language_centroids
from .licences import op4_licence_sentences
from .lines import SQL as LINES
from .lines import op12_line_runs
from .mixing import op9_source_mixing
from .piecewise import op2_piecewise_fingerprint
from .quality import op6_quality_gam
from .repetition import SQL as REPETITION
from .repetition import op1_suffix_repetition
from .search import SQL as SEARCH
from .search import op13_clustered_search
from .segmentation import op8_shared_prefix_viterbi
from .simhash import op3_simhash_trie
from .substrings import op7_substring_dedup
from .toxicity import op10_toxicity_counterfactual
from .whitening import op11_tiled_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_repetition, op2_piecewise_fingerprint, op3_simhash_trie, op4_licence_sentences, op5_language_centroids, op6_quality_gam,
        op7_substring_dedup, op8_shared_prefix_viterbi, op9_source_mixing, op10_toxicity_counterfactual, op11_tiled_whitening, op12_line_runs, op13_clustered_search,
    )
}

#: The others' fingerprints, models, permutations and byte strings are beyond SQL, or too slow in it over whole tables.
SQL: dict[str, str] = {"op1_suffix_repetition": REPETITION, "op12_line_runs": LINES, "op13_clustered_search": SEARCH}
