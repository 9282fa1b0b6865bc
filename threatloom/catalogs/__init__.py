"""Fixed catalogues: category, technique and requirement lists that results depend on."""
