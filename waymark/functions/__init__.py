"""Column functions: calendar, numbers, text and labels."""
