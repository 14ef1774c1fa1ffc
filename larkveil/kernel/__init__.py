"""What needs a whole text at a time: plain Python over one document, run inside Arrow batches."""
