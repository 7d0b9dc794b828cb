"""Files that tasks open by themselves, wherever they are stored."""

from __future__ import annotations

from urllib.parse import quote, unquote, urlsplit

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it; escapes of a URI are undone."""
    if not urlsplit(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + uri.removeprefix("file:").lstrip("/"))
    return fs.FileSystem.from_uri(uri)


def listed(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files below a folder, or of one file, in the order of their names; hidden ones are left out."""
    store, path = opened(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    top = path.rstrip("/")
    scheme = uri[: len(uri) - len(urlsplit(uri).path)] if urlsplit(uri).scheme and not uri.startswith("file:") else "file://"
    found = [x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File]
    seen = [x for x in found if not any(p.startswith((".", "_")) for p in x.path[len(top) :].split("/"))]
    base = urlsplit(uri).path.rstrip("/") if scheme != "file://" else top
    return sorted((scheme + quote(base + x.path[len(top) :], safe="/=:@!$&'()*+,;~"), x.size) for x in seen)
