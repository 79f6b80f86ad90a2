"""Numeric learning: box-constrained minimisation, bilinear models, edge weights, level mixtures, linear margins."""
