"""strataq: multi-model analytics as DataFrame, SQL and Structured Streaming plans."""
