"""Whole workflows: compress, restore, compare."""
