"""Pure Python parsing of e-mail; nothing here imports Spark."""
