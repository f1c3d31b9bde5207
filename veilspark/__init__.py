"""Finding, rewriting and measuring sensitive spans in text collections, on Spark."""
