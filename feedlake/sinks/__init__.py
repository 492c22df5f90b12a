"""Writers: feed lists, documents, transcripts, summaries and tables."""
