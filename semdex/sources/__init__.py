"""Sources: crawling, and text extraction from documents."""
