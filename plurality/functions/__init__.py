from plurality.functions.columns import col, comparable, nulls_last, unique
from plurality.functions.levels import as_ordinal, label_at, rank_of

__all__ = [
    "as_ordinal",
    "col",
    "comparable",
    "label_at",
    "nulls_last",
    "rank_of",
    "unique",
]
