"""Training-data preparation: ten operators over documents and conversations, and their queries."""
