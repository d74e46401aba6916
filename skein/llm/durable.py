"""Cutting lineage in the folder that the cluster shares."""

from skein.sources.durable import discard, shared_folder, written

__all__ = ["discard", "shared_folder", "written"]
