"""Files of an operator's own format on shared storage, for code that runs on executors and on the driver."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs ...) or of an absolute path."""
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    """A whole small file, seen under its name only when it is complete."""
    store, path = opened(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path + ".tmp") as out:
        out.write(data)
    store.move(path + ".tmp", path)


def read_bytes(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        return f.read()
