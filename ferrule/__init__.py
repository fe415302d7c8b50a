"""Part of ferrule, a Spark-first engine for document and source-code corpora."""
