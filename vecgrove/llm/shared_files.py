"""Files in the shared folder, opened by whichever worker has them to write or read."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def open_new(folder: str, suffix: str) -> tuple[BinaryIO, str]:
    """A new file under a name of its own, so that a repeated task never touches what another wrote."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def open_old(uri: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
