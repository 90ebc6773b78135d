"""Part of the document analytics library."""
