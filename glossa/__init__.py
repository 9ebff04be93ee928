"""A Spark-first engine for reference corpora and the text around them."""
