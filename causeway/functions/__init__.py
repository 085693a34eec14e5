"""Column functions and window frames that the operators share."""
