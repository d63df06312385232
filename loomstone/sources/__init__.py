"""Tables, file formats, and agent views of the driver's tables."""
