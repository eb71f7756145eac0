"""Writers: track documents, satellite documents, GPX, catalogues."""
