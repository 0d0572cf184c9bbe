"""gramian: mass-univariate statistics and training-data operators as PySpark jobs."""
