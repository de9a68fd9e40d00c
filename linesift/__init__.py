"""linesift: evidence-preserving text analytics as PySpark DataFrames."""
