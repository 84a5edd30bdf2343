"""One agreed rating per group of votes, as plain Spark DataFrame operations."""

from plurality.operators.audit import Audit, audit_ties, compare_cell
from plurality.operators.consensus import POLICIES, consensus, decide, decide_raw, scoreboard
from plurality.operators.indexing import group_index, number_rows, row_ids
from plurality.operators.nested import (
    flatten_forms,
    flatten_structs,
    parse_json,
    split_json_rejects,
    unnest,
)
from plurality.operators.relational import (
    append,
    copy_column,
    exclude,
    join_null_safe,
    lookup,
    move_to_front,
    natural_semi,
    normalise,
    project,
    semi_join,
    valid_votes,
    with_ranks,
)
from plurality.operators.reports import crosstab, frequencies, label_counts, score_summary
from plurality.operators.sampling import bootstrap, draws, sample_rows, seeded_order
from plurality.operators.tally import (
    clear_values,
    clear_winners,
    flagged_counts,
    raw_tie_breaks,
    raw_tie_rows,
    raw_winner_list,
    tie_breaks,
    tie_pool_contenders,
    tie_pool_overall,
    tie_rows,
    tied_groups,
    tied_values,
    top_values,
    union_missing,
    vote_counts,
    winner_list,
)
from plurality.plans.scoring import Scoring, score_and_publish, score_forms, score_votes
from plurality.schema import FORM_LAYOUT, VoteLayout
from plurality.sources.files import (
    publish,
    read_csv,
    read_json,
    read_table,
    write_csv,
    write_json,
    write_json_array,
    write_table,
)

__all__ = [
    "append",
    "Audit",
    "audit_ties",
    "bootstrap",
    "clear_values",
    "clear_winners",
    "compare_cell",
    "consensus",
    "copy_column",
    "crosstab",
    "decide",
    "decide_raw",
    "draws",
    "exclude",
    "flagged_counts",
    "flatten_forms",
    "flatten_structs",
    "FORM_LAYOUT",
    "frequencies",
    "group_index",
    "join_null_safe",
    "label_counts",
    "lookup",
    "move_to_front",
    "natural_semi",
    "normalise",
    "number_rows",
    "parse_json",
    "POLICIES",
    "project",
    "publish",
    "raw_tie_breaks",
    "raw_tie_rows",
    "raw_winner_list",
    "read_csv",
    "read_json",
    "read_table",
    "row_ids",
    "sample_rows",
    "score_and_publish",
    "score_forms",
    "score_summary",
    "score_votes",
    "scoreboard",
    "Scoring",
    "seeded_order",
    "semi_join",
    "split_json_rejects",
    "tie_breaks",
    "tie_pool_contenders",
    "tie_pool_overall",
    "tie_rows",
    "tied_groups",
    "tied_values",
    "top_values",
    "union_missing",
    "unnest",
    "valid_votes",
    "vote_counts",
    "VoteLayout",
    "winner_list",
    "with_ranks",
    "write_csv",
    "write_json",
    "write_json_array",
    "write_table",
]
