"""millrace: Spark-first operators for preparing language-model training corpora."""
