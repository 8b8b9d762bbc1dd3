"""sources of flowbench."""
