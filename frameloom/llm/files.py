"""Files that Python data sources write and read on executors, in any store that pyarrow has a filesystem for.

A task writes files with names of its own and tells them in its commit message; the driver's commit lists the files of the
successful attempts in a manifest. Readers only take what the manifest lists, so files of failed, repeated or lost
attempts don't count.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql.datasource import WriterCommitMessage

MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    fs, path = store(uri)
    fs.create_dir(path, recursive=True)


def write_manifest(uri: str, messages: list[Written | None]) -> None:
    fs, path = store(uri)
    files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{MANIFEST}") as out:
        out.write(json.dumps(files).encode())


def drop_files(uri: str, messages: list[Written | None]) -> None:
    fs, path = store(uri)
    for f in (f for m in messages if m for f in m.files):
        if fs.get_file_info(f"{path}/{f['name']}").type != pafs.FileType.NotFound:
            fs.delete_file(f"{path}/{f['name']}")


def listed(uri: str, suffixes: tuple[str, ...]) -> list[dict]:
    """Files of a folder: those of its manifest, else those with one of the suffixes; or the one file that uri is."""
    fs, path = store(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [{"path": path, "name": info.base_name, "bytes": info.size}]
    if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
            return [x | {"path": f"{path}/{x['name']}"} for x in json.loads(f.read())]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return [{"path": x.path, "name": x.base_name, "bytes": x.size} for x in sorted(found, key=lambda x: x.path) if x.type == pafs.FileType.File and x.base_name.endswith(suffixes)]
