"""Matrix operators."""
