"""functions of flowbench."""
