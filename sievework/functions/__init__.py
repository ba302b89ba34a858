"""Part of sievework, a Spark-native engine for postings and documents."""
