"""operators of histrank."""
