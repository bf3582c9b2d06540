"""Column functions; strings are measured in bytes where the text says so."""
