"""Files that tasks write to and read from the shared folder, whatever store it is in."""

from __future__ import annotations


def filesystem(uri: str):
    """``(pyarrow file system, path)`` of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_for_read(uri: str):
    """A seekable file: memory-mapped where the store is local."""
    import pyarrow as pa
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
