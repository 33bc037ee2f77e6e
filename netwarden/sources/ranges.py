"""Reading parts of files in tasks, in whatever store they lie."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes that a task reads at a time.
CHUNK = 8 << 20


def store_of(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder but the hidden ones."""
    from pyarrow import fs

    store, inner = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    inside = lambda f: f.path[len(inner.rstrip("/")) + 1 :]
    shown = [f for f in found if f.type == fs.FileType.File and not any(p[0] in "._" for p in inside(f).split("/"))]
    return sorted((f"{path.rstrip('/')}/{inside(f)}", f.size) for f in shown)


def opened(path: str):
    store, inner = store_of(path)
    return store.open_input_file(inner)


def chunks(path: str, start: int = 0, stop: int | None = None, size: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a range, piece by piece."""
    with opened(path) as handle:
        handle.seek(start)
        left = (handle.size() if stop is None else stop) - start
        while left > 0 and (piece := handle.read(min(size, left))):
            left -= len(piece)
            yield piece


def written(path: str, content: bytes) -> None:
    """A new file, whose folder is made where it is missing."""
    store, inner = store_of(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner) as handle:
        handle.write(content)
