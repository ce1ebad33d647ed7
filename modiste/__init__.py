"""modiste: product discovery over large catalogues as plain PySpark DataFrame jobs."""
