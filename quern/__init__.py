"""quern: a Spark-native engine for schemaless document collections."""
