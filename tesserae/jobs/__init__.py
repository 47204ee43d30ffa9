"""Whole jobs over folders of files: ``python -m tesserae.jobs NAME --help``."""
