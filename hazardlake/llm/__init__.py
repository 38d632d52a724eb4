"""Training-data operators: text, dialogue, page and shard preparation at corpus scale."""
