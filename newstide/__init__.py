"""newstide: a Spark-native engine for news, market event studies and corpus preparation."""
