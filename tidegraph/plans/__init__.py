"""The registered queries, each with its SQL where SQL can express it."""
