"""Training-data operators: ten corpus jobs, each in a module of its own."""
