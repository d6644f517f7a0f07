"""Publication-catalog analytics and corpus preparation as PySpark plans."""
