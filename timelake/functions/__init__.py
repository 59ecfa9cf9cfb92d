"""Column functions: clocks, text and scalars."""
