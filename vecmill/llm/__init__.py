"""Training-data operators: one module for each, thin queries in ``queries``."""
