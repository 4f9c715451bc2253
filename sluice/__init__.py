"""A Spark-native ingestion warehouse: declared tables, partitioned upserts, sorted bounded files, versioned manifests."""
