"""A ledger of paid calls: each answer is put under its key as soon as it is there, by the task that made the call."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyarrow import fs


class CallLedger:
    """Answers as small files under ``path``, in any store that Arrow opens (file:, hdfs:, s3:); made in a task, as it holds a connection.

    A file is written under a name of its own and then moved, so there is a whole answer or none. Two tasks that make the same call at the same time (speculation) both pay; the later answer stays."""

    def __init__(self, path: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)

    @staticmethod
    def digest(key: tuple) -> str:
        return hashlib.sha256(json.dumps([None if k is None else str(k) for k in key]).encode()).hexdigest()

    def _place(self, digest: str) -> str:
        return f"{self.root}/{digest[:2]}/{digest}.json"

    def get(self, digest: str) -> list | None:
        if self.store.get_file_info(self._place(digest)).type != fs.FileType.File:
            return None
        with self.store.open_input_stream(self._place(digest)) as f:
            return json.loads(f.read())

    def put(self, digest: str, answer: list) -> None:
        place, draft = self._place(digest), f"{self.root}/{digest[:2]}/.{uuid.uuid4().hex}"
        self.store.create_dir(f"{self.root}/{digest[:2]}", recursive=True)
        with self.store.open_output_stream(draft) as f:
            f.write(json.dumps(answer).encode())
        self.store.move(draft, place)
