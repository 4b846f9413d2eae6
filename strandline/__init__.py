"""strandline: feature analytics over ordered, per-entity event and instruction streams on Spark."""
