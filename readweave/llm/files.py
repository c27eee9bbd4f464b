"""Files of the shared store, opened on whichever executor."""

from __future__ import annotations


def open_file(path: str, write: bool = False):
    """A file of the shared store by its URI, on whichever executor."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    if write:
        store.create_dir(place.rpartition("/")[0], recursive=True)
        return store.open_output_stream(place, compression=None)
    return store.open_input_file(place)
