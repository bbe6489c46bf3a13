"""What will happen to each file: options, selections and plans."""
