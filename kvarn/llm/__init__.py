"""Training-data operators: ten self-contained jobs over document, page, vector and chat tables."""
