"""facetry: Spark-first analytics over document corpora and their feature-by-document weights."""
