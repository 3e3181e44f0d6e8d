"""The library's work stated over the general test tables: an analogue star, queries, and their SQL."""
