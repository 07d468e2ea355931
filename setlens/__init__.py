"""Set-aware retrieval analytics and data preparation as Spark DataFrame transformations."""
