"""What a folder of block files holds: lists of files that are published whole, after the files, and that readers follow.

A list is one file ``_manifest/<name>.jsonl``, a line a block file: its folder, name, complete bytes, blocks, rows and the
least and greatest of every number column.  It gets its name by a rename, so it is there whole or not at all; a list
that is published again under the same name changes nothing.  Files that no list names (of lost or failed tasks) and what
a file holds beyond its complete bytes do not exist for readers.  A folder without lists holds all its ``*.bin``.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs

FOLDER = "_manifest"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def write_whole(uri: str, name: str, content: bytes) -> bool:
    """A file that is there whole or not at all; False, and nothing is written, where there is one of that name."""
    store, folder = store_of(uri)
    if store.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
        return False
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(content)
    store.move(hidden, f"{folder}/{name}")
    return True


def publish(uri: str, name: str, entries: list[dict]) -> bool:
    return write_whole(f"{uri}/{FOLDER}", f"{name}.jsonl", "".join(json.dumps(e) + "\n" for e in entries).encode())


def _lists(uri: str) -> list[tuple[fs.FileSystem, str]]:
    store, folder = store_of(uri)
    found = store.get_file_info(fs.FileSelector(f"{folder}/{FOLDER}", allow_not_found=True))
    return [(store, i.path) for i in sorted(found, key=lambda i: i.path) if i.path.endswith(".jsonl")]


def entries(uri: str, *more: str | None) -> list[dict]:
    """The files of a folder and of others that took its place: ``folder``, ``file``, ``bytes`` and, where a list says so, more."""
    folders = [uri, *(m for m in more if m)]
    lists = [x for f in folders for x in _lists(f)]
    out = []
    for store, path in lists:
        with store.open_input_stream(path) as file:
            out += [json.loads(line) for line in file.read().splitlines()]
    if lists:
        return out
    for name in folders:
        store, folder = store_of(name)
        info = store.get_file_info(folder)
        if info.type == fs.FileType.File:
            up, _, base = name.rpartition("/")
            out.append({"folder": up, "file": base, "bytes": info.size})
            continue
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=name != uri))
        names = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.endswith(".bin"))
        out += [{"folder": name, "file": path[len(folder.rstrip("/")) + 1 :], "bytes": size} for path, size in names]
    return out
