"""Training-data operators: ten corpus-preparation steps, each usable on its own."""
