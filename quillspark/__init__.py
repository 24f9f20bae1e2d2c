"""Text-correction analytics on Spark."""
