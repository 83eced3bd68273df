"""Files in the shared folder, written and read by executors through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs as afs


def filesystem(folder: str) -> tuple[afs.FileSystem, str]:
    """The file system and path of a URI; a plain path is a mounted folder."""
    return afs.FileSystem.from_uri(folder) if "://" in folder else (afs.LocalFileSystem(), folder)
