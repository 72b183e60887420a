"""Matrix operators as DataFrame plans."""
