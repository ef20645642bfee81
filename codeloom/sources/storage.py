"""Access to folders and files from inside tasks, through Arrow's file systems."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

#: Bytes of the files that go back to Spark together; a larger file goes alone.
BATCH_BYTES = 1 << 26


def locate(uri: str):
    """The file system of a URI or local path, and the path within it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def in_batches(files: Iterable[tuple[str, bytes]], size: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
    """``(path, content)`` in frames of at most ``size`` bytes."""
    held, total = [], 0
    for path, content in files:
        if held and total + len(content) > size:
            yield pd.DataFrame(held, columns=["path", "content"])
            held, total = [], 0
        held.append((path, content))
        total += len(content)
    if held:
        yield pd.DataFrame(held, columns=["path", "content"])
