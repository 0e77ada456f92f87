"""tessera: a Spark-native engine for grounded retrieval, evaluation and corpus preparation."""
