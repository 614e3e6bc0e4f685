"""Spark-native analytics over crawled web pages: URLs, HTML, contacts, crawl policy."""
