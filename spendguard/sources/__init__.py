from spendguard.sources.expenses import as_expenses, read_expenses, read_index
from spendguard.sources.layers import load_or_build, read_layer, write_layer
from spendguard.sources.results import read_results, write_metrics, write_ranking, write_results, write_run
from spendguard.sources.sets import read_set, write_set

__all__ = [
    "as_expenses",
    "load_or_build",
    "read_expenses",
    "read_index",
    "read_layer",
    "read_results",
    "read_set",
    "write_layer",
    "write_metrics",
    "write_ranking",
    "write_results",
    "write_run",
    "write_set",
]
