"""streaming of flowbench."""
