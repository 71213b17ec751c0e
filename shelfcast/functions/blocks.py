"""Blocks of arrays as files in the session's shared folder, written and read inside tasks.

A file is written under a name of its own and then moved to its final one, so a task that runs twice leaves one
whole file, and a reader never sees half of one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs as pafs


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def save_block(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for x in arrays:
            out.write(f"{x.dtype.str}:{','.join(map(str, x.shape))}".ljust(64).encode())
            out.write(np.ascontiguousarray(x).tobytes())
    fs.move(own, f"{path}/{name}")


def load_block(folder: str, name: str) -> list[np.ndarray]:
    fs, path = opened(folder)
    with fs.open_input_stream(f"{path}/{name}") as stream:
        raw = stream.read()
    out, at = [], 0
    while at < len(raw):
        kind, _, shape = raw[at:at + 64].decode().strip().partition(":")
        shape = tuple(int(n) for n in shape.split(",") if n)
        n = int(np.prod(shape, dtype=np.int64)) * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, kind, count=n // np.dtype(kind).itemsize, offset=at + 64).reshape(shape))
        at += 64 + n
    return out
