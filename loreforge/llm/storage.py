"""Tables in the folder that the whole cluster shares, as the rest of the library cuts lineage too."""

from __future__ import annotations

from loreforge.sources.scratch import SETTING, shared_dir, shared_path, written

__all__ = ["SETTING", "shared_dir", "shared_path", "written"]
