"""quarry: a Spark-native search-analytics engine over a text corpus with linked metadata."""
