"""Answers that have been paid for, kept as they come, so that none is asked for twice.

A task writes each answer to a file of its own, named by the prompt's fingerprint, before it asks for the
next one, and looks there first. So a task that is run again, and a later run over the same prompts, ask
only for what is missing. The folder is reached through ``pyarrow.fs``: a mounted folder, or the address
of a store that pyarrow knows. A run's end of quota is a file too, which all of its tasks look for.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow.fs as pafs


def fingerprint(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class Journal:
    """A folder of answers; ``run`` names the run whose end of quota is told."""

    def __init__(self, folder: str, run: str | None = None):
        self.folder, self.run = folder, run or uuid.uuid4().hex

    def _open(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.folder or self.folder.startswith("file:"):
            return pafs.FileSystem.from_uri(self.folder)
        return pafs.LocalFileSystem(), self.folder

    def _place(self, name: str) -> tuple[pafs.FileSystem, str]:
        files, top = self._open()
        return files, f"{top}/{name[:2]}/{name}.json"

    def _read(self, name: str) -> dict | None:
        files, path = self._place(name)
        if files.get_file_info(path).type != pafs.FileType.File:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _write(self, name: str, content: dict) -> None:
        """The file appears whole: it is written beside its place and moved there."""
        files, path = self._place(name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        hidden = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as f:
            f.write(json.dumps(content).encode())
        files.move(hidden, path)

    def answer(self, key: str) -> str | None:
        found = self._read(key)
        return None if found is None else found["output"]

    def keep(self, key: str, output: str) -> None:
        self._write(key, {"output": output})

    def stop(self, why: str) -> None:
        self._write(f"stop-{self.run}", {"why": why})

    def stopped(self) -> str | None:
        found = self._read(f"stop-{self.run}")
        return None if found is None else found["why"]
