"""Training-corpus operators: ten numbered operators and what they share."""
