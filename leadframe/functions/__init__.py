"""Column functions: text, URLs, collections and dates.  All JVM side."""
