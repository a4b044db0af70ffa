"""Column functions: decibels, labels, dates, keyed random numbers."""
