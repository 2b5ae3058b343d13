from .files import headed_csv, id_lines, json_lines, points_csv, quoted_transactions, sampled_batches
from .tables import table

__all__ = [
    "headed_csv",
    "id_lines",
    "json_lines",
    "points_csv",
    "quoted_transactions",
    "sampled_batches",
    "table",
]
