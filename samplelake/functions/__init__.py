"""Column functions: text clean-up, reply parsing, file types."""
