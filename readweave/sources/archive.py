"""Release archives of bundles: one file whose bytes follow from the bundle's alone, lists of digests, and extraction that
trusts no name in an archive. An archive holds one lexicon and goes through the driver as a stream.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession

from readweave.sources.lexicon import Bundle, LexiconError, list_bundles, load_bundle

#: Limits on what is extracted
MAX_FILES, MAX_BYTES = 10_000, 8 << 30
CHUNK = 1 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def files_of(folder: str) -> list[tuple[str, str]]:
    """(name within the folder, path) of its data files, in the order of the names; hidden files and markers are left out."""
    store, root = _store(folder)
    some = [(f.path[len(root.rstrip("/")) + 1 :], f.path) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
    return sorted((name, path) for name, path in some if not any(x.startswith((".", "_")) for x in name.split("/")))


@contextmanager
def _zipped(out: BinaryIO, compression: str) -> Iterator[BinaryIO]:
    if compression == "gz":
        with gzip.GzipFile(filename="", mode="wb", compresslevel=9, fileobj=out, mtime=0) as z:
            yield z
    elif compression == "zst":
        import zstandard

        with zstandard.ZstdCompressor(level=19).stream_writer(out, closefd=False) as z:
            yield z
    else:
        raise ValueError("the compression is 'gz' or 'zst'")


def write_archive(bundle: str, path: str, *, name: str, compression: str = "gz") -> str:
    """Write a bundle's files under the folder `name` to an archive; returns its SHA-256. Equal files give equal bytes:
    entries are sorted and have no times, owners or modes of their own."""
    store, at = _store(path)
    with store.open_output_stream(at, compression=None) as raw, _zipped(raw, compression) as out, tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT) as tar:
        for member, source in files_of(bundle):
            info = tarfile.TarInfo(f"{name}/{member}")
            source_store = _store(bundle)[0]
            info.size = source_store.get_file_info(source).size
            info.mode = 0o644
            with source_store.open_input_file(source) as f:
                tar.addfile(info, f)
    return digest(path)


def digest(path: str) -> str:
    """SHA-256 of a file."""
    store, at = _store(path)
    state = hashlib.sha256()
    with store.open_input_file(at) as f:
        while data := f.read(CHUNK):
            state.update(data)
    return state.hexdigest()


def checksums(paths: Iterable[str]) -> str:
    """Lines of digests and file names, in the order of the names, as checksum tools read them."""
    rows = sorted((p.rstrip("/").rpartition("/")[2], p) for p in paths)
    if len({name for name, _ in rows}) < len(rows):
        raise ValueError("two files have the same name")
    return "".join(f"{digest(p)}  {name}\n" for name, p in rows)


def expected(sums: str, name: str) -> str:
    """The digest that a list has for a file."""
    for line in sums.splitlines():
        found, _, of = line.partition("  ")
        if of.strip().lstrip("*") == name:
            if len(found) != 64 or set(found.lower()) - set("0123456789abcdef"):
                raise LexiconError(f"{name}: not a SHA-256")
            return found.lower()
    raise LexiconError(f"no digest of {name}")


def _members(path: str) -> Iterator[tuple[tarfile.TarInfo, BinaryIO]]:
    store, at = _store(path)
    with store.open_input_file(at) as raw:
        head = raw.read(4)
        raw.seek(0)
        if head[:2] == b"\x1f\x8b":
            data: BinaryIO = gzip.GzipFile(fileobj=raw)
        elif head == b"\x28\xb5\x2f\xfd":
            import zstandard

            data = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw))
        else:
            raise LexiconError("neither a gzip nor a Zstandard archive")
        with tarfile.open(fileobj=data, mode="r|") as tar:
            for info in tar:
                yield info, tar.extractfile(info) if info.isfile() else None


def extract_archive(path: str, into: str, *, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> list[str]:
    """Extract an archive's files under the new folder `into`; returns their names. Links, special files, names that lead
    out or come twice, and archives over the limits are errors, after which the folder is gone."""
    store, root = _store(into)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise LexiconError(f"{into} is there already")
    names: list[str] = []
    size = 0
    try:
        store.create_dir(root, recursive=True)
        for info, data in _members(path):
            parts = info.name.rstrip("/").split("/")
            if info.name.startswith("/") or "\\" in info.name or ".." in parts or "" in parts or "." in parts:
                raise LexiconError(f"{info.name!r} leads out of the archive")
            if info.isdir():
                continue
            if data is None:
                raise LexiconError(f"{info.name!r} is neither a file nor a folder")
            size += info.size
            if info.name in names or len(names) >= max_files or size > max_bytes:
                raise LexiconError(f"{info.name!r} comes twice, or the archive is over the limits")
            names.append(info.name)
            store.create_dir(f"{root}/{info.name}".rpartition("/")[0], recursive=True)
            with store.open_output_stream(f"{root}/{info.name}", compression=None) as out:
                while block := data.read(CHUNK):
                    out.write(block)
    except (LexiconError, tarfile.TarError, OSError) as e:
        store.delete_dir(root)
        raise e if isinstance(e, LexiconError) else LexiconError(f"not an archive, or a damaged one: {e}") from e
    return names


def install(spark: SparkSession, archive: str, root: str, *, sums: str | None = None) -> list[Bundle]:
    """Extract an archive into a folder of bundles, where default lexicons are looked for, and load and verify what it
    holds; with `sums`, its digest must be the listed one. What doesn't verify is deleted."""
    name = archive.rstrip("/").rpartition("/")[2]
    if sums is not None and digest(archive) != expected(sums, name):
        raise LexiconError(f"the digest of {name} differs from the list")
    waiting = f"{root.rstrip('/')}/.new-{hashlib.sha256(name.encode()).hexdigest()[:16]}"
    tops = sorted({x.partition("/")[0] for x in extract_archive(archive, waiting)})
    store, place = _store(waiting)
    try:
        for top in tops:
            load_bundle(spark, f"{waiting}/{top}")
            if where(spark, root, top) is not None:
                raise LexiconError(f"{top} is installed already")
        for top in tops:
            store.move(f"{place}/{top}", f"{_store(root)[1].rstrip('/')}/{top}")
    finally:
        store.delete_dir(place)
    return [load_bundle(spark, f"{root.rstrip('/')}/{top}", verify=False) for top in tops]


def where(spark: SparkSession, root: str, name: str) -> str | None:
    """The path of an installed bundle, by its folder's or its own name."""
    return next((p for p, meta in list_bundles(spark, root) if name in (p.rstrip("/").rpartition("/")[2], meta.get("name"))), None)
