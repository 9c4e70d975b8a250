"""Study-corpus analytics on PySpark: retrieval, document, learning-memory and conversation operators."""
