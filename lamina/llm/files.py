"""Files in the shared folder, from executors too: any store that pyarrow's file systems reach."""

import re
import uuid

from pyarrow import fs


def _at(path):
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Output:
    """A binary file that gets its name only when it is complete: a lost or doubled task leaves no half file."""

    def __init__(self, path):
        self.fs, self.path = _at(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.own, compression=None)

    def write(self, data):
        self.out.write(data)
        return len(data)

    def tell(self):
        return self.out.tell()

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.out.close()
        if kind:
            self.fs.delete_file(self.own)
        else:
            self.fs.move(self.own, self.path)


def opened(path):
    """A seekable file for reading."""
    where, path = _at(path)
    return where.open_input_file(path)


def read(path):
    with opened(path) as f:
        return f.read()
