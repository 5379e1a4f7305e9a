"""Analytics for code-review data as DataFrame, SQL and Structured Streaming operators."""
