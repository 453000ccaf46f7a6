"""Block-structured storage images as relational tables, queried and rewritten with Spark."""
