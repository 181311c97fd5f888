"""Column functions: parsing, geometry and angles, vectors, hashes."""
