"""Composed jobs: bulk screening, list reload, reports, and the views on the driver tables."""
