"""Column functions: names, similarity, time, places."""
