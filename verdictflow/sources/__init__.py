"""verdictflow.sources."""
