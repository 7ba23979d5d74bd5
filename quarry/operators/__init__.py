"""Operators over DataFrames: filters, ordering and paging."""
