"""Reading files into typed tables, and keeping them."""
