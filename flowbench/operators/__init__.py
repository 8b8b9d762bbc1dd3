"""operators of flowbench."""
