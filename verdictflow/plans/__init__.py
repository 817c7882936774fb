"""verdictflow.plans."""
