"""Readers and writers; the jobs themselves never touch a path."""
