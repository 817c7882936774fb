"""verdictflow.functions."""
