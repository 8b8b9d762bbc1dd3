"""plans of flowbench."""
