"""functions of histrank."""
