"""Tables, files and the shared folder."""
from fadegraph.sources.shared import discard, materialise, release, scratch_path, shared_root
from fadegraph.sources.tables import table

__all__ = ["discard", "materialise", "release", "scratch_path", "shared_root", "table"]
