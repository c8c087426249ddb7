"""Column expressions: text, ranks, scores, vectors, ids, json."""
