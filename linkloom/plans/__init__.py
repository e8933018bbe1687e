"""Whole matching runs, composed of the operators."""
