"""Table schemas, the Tables bundle, reader, versioned writer and fixture tables."""
