"""foliant: hybrid document retrieval, evidence routing and corpus preparation on PySpark."""
