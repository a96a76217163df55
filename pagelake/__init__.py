"""pagelake: Spark-native operators over crawled pages, documents and run ledgers."""
