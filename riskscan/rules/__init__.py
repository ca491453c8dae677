"""The built-in rules: a catalog of what they mean and functions that emit candidates."""
