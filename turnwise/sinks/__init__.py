"""Writers for documents, readable transcripts, reports and timelines."""
