"""Estimator catalog, model search and the distributed unsupervised methods."""
