"""Column functions: pitch, note, grid and text formats."""
