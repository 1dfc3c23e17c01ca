"""Named analyses.  Tokens are ``volume, book, chapter, word``; bigrams likewise."""
