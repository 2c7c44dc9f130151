"""Where documents come from and go to: the index catalog, stored indices, bulk requests."""
