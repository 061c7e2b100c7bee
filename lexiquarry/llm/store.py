"""Files that Python workers write to and read from the shared folder, by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def put(uri: str, parts: list) -> None:
    """Writes under another name and renames, so a task that runs again leaves one whole file."""
    system, path = at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with system.open_output_stream(temp) as out:
        for p in parts:
            out.write(p)
    system.move(temp, path)


def get(uri: str) -> memoryview:
    system, path = at(uri)
    with system.open_input_file(path) as f:
        return memoryview(f.read_buffer()).cast("B")


def files(uri: str, suffix: tuple[str, ...]) -> list[str]:
    system, path = at(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(uri.rstrip("/") + x.path[len(path.rstrip("/")) :] for x in found if x.type == fs.FileType.File and x.path.endswith(suffix))
