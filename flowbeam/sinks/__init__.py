"""Writers: date-partitioned flow Parquet, documents, keyed upserts, result sets, specs."""
