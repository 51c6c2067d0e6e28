"""Search, relation and audit of a corpus of structured memory documents, as Spark plans."""
