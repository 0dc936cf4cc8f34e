"""Long-term-memory analytics on Spark: search, deduplication, upkeep and
reports over notes, tasks, transcripts and embeddings held as DataFrames."""
