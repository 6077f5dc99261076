"""Reading sales files and payloads, validating them, and writing published tables."""
