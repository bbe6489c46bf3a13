"""Analysis and cleaning of picture metadata, and of the text tables beside it, on Spark."""
