"""verdictflow.streaming."""
