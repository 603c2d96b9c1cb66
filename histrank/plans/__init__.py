"""plans of histrank."""
