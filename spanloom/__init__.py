"""spanloom: analytics over AI-agent traces, expressed as Spark DataFrame operators."""
