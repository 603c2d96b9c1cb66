"""streaming of histrank."""
