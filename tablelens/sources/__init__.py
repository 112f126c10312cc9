"""Reading and writing metadata documents."""
