"""verdictflow.operators."""
