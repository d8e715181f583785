"""Document and market analytics written as PySpark DataFrame programs."""
