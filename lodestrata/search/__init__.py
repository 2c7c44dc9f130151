"""Search: requests compiled to DataFrame plans."""
