"""Files by the locations that Spark writes, opened in tasks through Arrow; no character of a name is special."""

from __future__ import annotations

import os
import re
from functools import lru_cache

from pyarrow import fs

#: Spark's names of stores that Arrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


@lru_cache(64)
def store_of(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    """A file system, made once a worker, and what precedes a path in it."""
    if scheme == "file":
        return fs.LocalFileSystem(), ""
    store, prefix = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{authority}/")
    return store, prefix.rstrip("/")


def parts_of(path: str) -> tuple[str, str, str]:
    """Scheme, authority and path of an unescaped location; one without a scheme is local."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)", path, re.DOTALL)
    return (m[1].lower(), m[2] or "", m[3]) if m else ("file", "", os.path.abspath(path))


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a location, and the path there."""
    scheme, authority, at = parts_of(path)
    store, prefix = store_of(scheme, authority)
    return store, prefix + at
