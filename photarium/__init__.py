"""Library-index and near-duplicate analytics expressed on PySpark DataFrames."""
