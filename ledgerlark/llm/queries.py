"""The registered queries of the text operators, and SQL for those that DuckDB can restate."""

from .ball_tree import OP11_SQL, op11_ball_tree_search
from .bpe import op2_bpe
from .centroids import OP13_SQL, op13_orchard_clusters
from .decontaminate import op10_contamination
from .exact import OP8_SQL, op8_exact_groups
from .language_model import op6_partial_matching
from .near_duplicates import op9_near_duplicates
from .personal_data import op3_personal_data
from .quality import op5_quality
from .rank_bpe import op12_rank_bpe
from .secret_scan import op1_secrets
from .substrings import op7_repeated_spans
from .token_rollup import OP4_SQL, op4_token_rollup

QUERIES = {
    q.__name__: q
    for q in (
        op1_secrets, op2_bpe, op3_personal_data, op4_token_rollup, op5_quality, op6_partial_matching, op7_repeated_spans, op8_exact_groups,
        op9_near_duplicates, op10_contamination, op11_ball_tree_search, op12_rank_bpe, op13_orchard_clusters,
    )
}
ORACLES = {"op4_token_rollup": OP4_SQL, "op8_exact_groups": OP8_SQL, "op11_ball_tree_search": OP11_SQL, "op13_orchard_clusters": OP13_SQL}
