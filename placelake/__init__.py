"""PySpark-native tables of physical locations from crawled pages and catalogs."""
