"""Training-data operators: each module holds one operator, its registered query and its SQL."""
