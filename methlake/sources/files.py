"""Opening files by path or URI inside a task, through Arrow's file systems."""

from __future__ import annotations

import glob
import hashlib
import json

from pyarrow import fs as pafs


def qualified(spark, path: str) -> str:
    """The path as Spark reports it for the rows of its files: absolute, decoded, without a scheme if local."""
    jvm = spark.sparkContext._jvm
    given = jvm.org.apache.hadoop.fs.Path(path)
    uri = given.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(given).toUri()
    if uri.getScheme() == "file":
        return uri.getPath()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def file_size(path: str) -> int | None:
    """Length in bytes, or None when there is no such file."""
    system, inner = resolve(path)
    info = system.get_file_info(inner)
    return info.size if info.type == pafs.FileType.File else None


def read_bytes(path: str) -> bytes:
    system, inner = resolve(path)
    with system.open_input_file(inner) as f:
        return f.read()


def expand(options: dict) -> list[str]:
    """Input paths of a reader: `paths` (a JSON list) or `path` (one path or a local glob)."""
    if "paths" in options:
        return list(json.loads(options["paths"]))
    path = options["path"]
    if "://" not in path and any(ch in path for ch in "*?["):
        return sorted(glob.glob(path))
    return [path]


def read_range(path: str, offset: int, n: int) -> bytes:
    system, inner = resolve(path)
    with system.open_input_file(inner) as f:
        return f.read_at(n, offset)


def open_output(path: str):
    """A writable stream; missing parent folders are made."""
    system, inner = resolve(path)
    if "/" in inner:
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def seekable(path: str) -> str | None:
    """The path for the operating system where the file lies on a (mounted) file system; None in an object store."""
    system, inner = resolve(path)
    return inner if isinstance(system, pafs.LocalFileSystem) else None


def write_text(path: str, text: str) -> None:
    with open_output(path) as f:
        f.write(text.encode())


def read_text(path: str) -> str:
    return read_bytes(path).decode("utf-8", "replace")


def move(source: str, target: str) -> None:
    system, a = resolve(source)
    system.move(a, resolve(target)[1])


def copy(source: str, target: str) -> None:
    (from_system, a), (to_system, b) = resolve(source), resolve(target)
    to_system.create_dir(b.rsplit("/", 1)[0], recursive=True)
    pafs.copy_files(a, b, source_filesystem=from_system, destination_filesystem=to_system)


def list_files(folder: str) -> list[str]:
    """Plain files directly inside a folder, by name."""
    system, inner = resolve(folder)
    infos = system.get_file_info(pafs.FileSelector(inner))
    return sorted(i.base_name for i in infos if i.type == pafs.FileType.File)


def sha256_of(path: str) -> str:
    """Digest of a file, streamed."""
    digest, system_path = hashlib.sha256(), resolve(path)
    with system_path[0].open_input_stream(system_path[1]) as f:
        while chunk := f.read(8 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def remove_folder(folder: str) -> None:
    system, inner = resolve(folder)
    system.delete_dir(inner)


def is_folder(path: str) -> bool:
    system, inner = resolve(path)
    return system.get_file_info(inner).type == pafs.FileType.Directory
