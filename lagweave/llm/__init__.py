"""Training-data operators: quality, tokens, archives, duplicates, language, URLs, mixing."""
