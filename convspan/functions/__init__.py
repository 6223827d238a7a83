"""Functions on columns that operators and sources share."""
