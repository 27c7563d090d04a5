"""Timeline analytics on Spark: ordered events, segments, transcripts and feature vectors."""
