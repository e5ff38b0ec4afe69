"""Preference-data engine on Spark: forum dumps to text pairs, prompts, token arrays, batches and scores."""
