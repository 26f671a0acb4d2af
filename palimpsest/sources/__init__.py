"""Sources and sinks: memory tables, intake documents, idempotent appends."""
