"""Find, explain and rank unusual spending records with Spark.

Every operator is a function from DataFrames to a DataFrame.  Fact tables use the column names of
`spendguard.columns`; `spendguard.sources.as_expenses` renames any table to them.
"""

from spendguard.params import Params

__all__ = ["Params"]
