"""Reading and writing of documents, chunks, evaluation sets and reports."""
