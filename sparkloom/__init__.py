"""An analytics engine on PySpark DataFrames."""
