"""Operators for preparing large text, vector and web tables for training."""
