"""Reading files and registries; writing reports."""
