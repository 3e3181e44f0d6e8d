"""Readers of the landing area. Parsers take raw snapshots (``schemas.RAW_SNAPSHOT``: one row per file, whole
text) and return ``(good, rejects)``.

A file is one row and is parsed by one task, so land many moderate files rather than a few huge ones. Within
a file everything is JVM column expressions; nothing passes through the driver.
"""
