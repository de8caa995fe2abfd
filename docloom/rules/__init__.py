"""The document types that come with the package, as data (types.yaml)."""
