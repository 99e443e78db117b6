"""Content-addressed data on Spark: chunk, deduplicate, pack, index, snapshot, check, restore."""
