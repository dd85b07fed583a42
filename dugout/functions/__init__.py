"""Column functions: coercions, rates and the event grammar."""
