"""Column functions: text cleaning, vocabulary and token encoding."""
