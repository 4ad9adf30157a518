"""A Spark-native engine for document corpora: parsing, graphs, postings, vectors, retrieval, evaluation."""
