"""Part of colstrata."""
