"""Scan files in, meshes out."""

from .readers import load_scan, load_directory, procedural_scan  # noqa: F401
from .writers import write_obj, write_ply  # noqa: F401
