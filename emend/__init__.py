"""Text-correction analytics on Spark: readers, text functions, edit algebra, retrieval and scoring."""
