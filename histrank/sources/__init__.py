"""sources of histrank."""
