"""Column functions over images, colours and geometry; JVM side, no Python."""
