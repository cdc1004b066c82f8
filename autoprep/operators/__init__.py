"""Cleaning, profiling, transforming, splitting, balancing and metric operators."""
