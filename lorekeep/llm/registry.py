"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op4_ann_balanced_postings
from .bpe import op9_bpe_pair_index
from .collocations import OP12_SQL, op12_collocations_suffix_array
from .forest import op3_rp_forest_near_dup
from .jaccard import op8_jaccard_adaptive_prefix
from .levels import op11_sum_of_squares
from .packing import op2_best_fit_linear_grouping
from .ppm import op6_ppm_code_length
from .quality import op10_quality_bradley_terry
from .toxicity import op5_toxicity_subword_bag
from .url_filter import OP7_SQL, op7_url_temporal_list_join
from .warc import OP1_SQL, op1_warc_external_merge
from .whitening import op13_whitening_svd

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_external_merge,
        op2_best_fit_linear_grouping,
        op3_rp_forest_near_dup,
        op4_ann_balanced_postings,
        op5_toxicity_subword_bag,
        op6_ppm_code_length,
        op7_url_temporal_list_join,
        op8_jaccard_adaptive_prefix,
        op9_bpe_pair_index,
        op10_quality_bradley_terry,
        op11_sum_of_squares,
        op12_collocations_suffix_array,
        op13_whitening_svd,
    )
}
#: The others are learned models, walks of graphs or trees, or too slow in SQL on whole tables; tests/llm holds them against brute force.
ORACLE_SQL = {"op1_warc_external_merge": OP1_SQL, "op7_url_temporal_list_join": OP7_SQL, "op12_collocations_suffix_array": OP12_SQL}
