"""Storage: catalog, layouts, CSV import."""
