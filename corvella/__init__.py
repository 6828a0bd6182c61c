"""corvella: document-retrieval analytics as PySpark DataFrame transformations."""
