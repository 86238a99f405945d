"""tidemark: point-in-time analytics over ordered entity tables, expressed as Spark plans."""
