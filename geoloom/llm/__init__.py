"""Training-data operators; nothing outside this folder imports it (``__spark_entry__`` adds it when present)."""
