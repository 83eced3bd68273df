"""Permission-aware retrieval, evidence grading and corpus processing on PySpark."""
