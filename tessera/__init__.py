"""A retrieval and text-analytics engine written as Spark DataFrame plans."""
