"""Training-data operators: ten jobs over documents and conversations, and their queries."""
