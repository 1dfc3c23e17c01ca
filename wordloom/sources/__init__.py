"""Reading and writing texts and tables."""
