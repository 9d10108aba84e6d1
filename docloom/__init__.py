"""docloom: retrieval analytics and corpus preparation as PySpark DataFrame plans."""
