"""staylens: short-term-rental analytics written as Spark jobs."""
