"""Page-topic pipeline as PySpark DataFrame transformations."""
