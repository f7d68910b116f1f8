"""Stateful folds over event streams."""
