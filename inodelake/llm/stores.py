"""Binary files written by tasks into a folder that all executors share."""

from __future__ import annotations

import uuid


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write ``data`` as ``folder``/``name`` in one step: a retried task replaces its own file, a lost one leaves none half written."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")
    return f"{folder}/{name}"
