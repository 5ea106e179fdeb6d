"""The four tools: assembly, summary, confidential, pipeline."""
