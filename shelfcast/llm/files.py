"""Files in the shared folder, written and read inside tasks.

The folder's URI decides the file system. A task returns the names it wrote; Spark's commit of those
names makes files count, so what a failed or repeated task left behind is never read.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return fs, path


def save(folder: str, suffix: str, parts: list[bytes]) -> str:
    """A new file of these bytes; its name within the folder."""
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with fs.open_output_stream(f"{path}/{name}") as out:
        for x in parts:
            out.write(x)
    return name
