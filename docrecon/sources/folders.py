"""A folder tree as a stream: executors list its folders in rounds, and what is out of scope never is listed.

The format ``folder_tree`` gives path, filename and size_bytes of PDF files, hidden ones too. Of other years' and other
banks' folders nothing is listed, let alone opened. Its state, a folder that driver and executors share, holds the lists of
folders of each round. A task takes one list, goes down from its folders a level at a time until it has listed ``DUTY`` of
them, and leaves the others to the next round as lists of ``FOLDERS`` each; so a small tree is one task, and a large one is
soon spread over all. An offset is a round and how many of its lists are done. A round's lists are all there once the round
before is done, so the same offsets mean the same folders, and a restarted query goes on where it stood.

A task that is run again replaces its lists. Folders that can't be read hold nothing, and links to folders aren't followed.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from docrecon.settings import FY_FOLDER, Settings
from docrecon.streaming.control import Gate

SCHEMA = "path string, filename string, size_bytes long"
#: Folders that a task lists, folders of a list that is left to the next round, and lists of a micro-batch.
DUTY, FOLDERS, LISTS = 256, 16, 1024


def year_name(name: str) -> str:
    """A year's folder name without spaces, in upper case."""
    return "".join(name.split()).upper()


def may_hold(parts: Sequence[str], fy: str | None, bank: str | None) -> bool:
    """Whether a folder (its names from the root on) can hold documents of the year and bank: it is no other year's folder,
    and not the folder of another bank, which is the one after the first ``payments``."""
    if fy and re.match(FY_FOLDER, parts[-1]) and year_name(parts[-1]) != year_name(fy):
        return False
    low = [p.lower() for p in parts]
    after = low.index("payments") + 1 if "payments" in low else len(low)
    return not bank or after >= len(low) or low[after] == bank.lower()


def below(path: str, root: str) -> list[str]:
    """The names of a path from ``root`` on, or all of them if it doesn't lie there."""
    base = root.rstrip("/") + "/"
    return [p for p in (path[len(base) :] if root and path.startswith(base) else path).split("/") if p]


def list_folder(folder: str, root: str = "", fy: str | None = None, bank: str | None = None) -> tuple[list[str], list[tuple[str, str, int]]]:
    """The subfolders in scope, and (path, name, bytes) of the PDF files, of one folder."""
    folders, files = [], []
    try:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if may_hold(below(e.path, root), fy, bank):
                            folders.append(e.path)
                    elif e.name.lower().endswith(".pdf"):
                        files.append((e.path, e.name, e.stat().st_size))
                except OSError:  # gone meanwhile, or a link to nowhere
                    continue
    except OSError:
        pass
    return sorted(folders), sorted(files)


def _put(path: str, value) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.{os.getpid()}.tmp", "w", encoding="utf-8") as file:
        json.dump(value, file)
    os.replace(f"{path}.{os.getpid()}.tmp", path)


def _get(path: str):
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class FolderTree(DataSource):
    """``spark.readStream.format("folder_tree")`` with the options root, state, and fy, bank, base, gate, lists."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


class FolderList(InputPartition):
    """One file of a round's lists."""

    def __init__(self, number: int, name: str) -> None:
        self.number, self.list_name = number, name


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.state = options["root"], options["state"]
        self.base, self.fy, self.bank = options.get("base", ""), options.get("fy"), options.get("bank")
        self.gate = Gate(options["gate"]) if options.get("gate") else None
        self.step = int(options.get("lists", LISTS))

    def _round(self, number: int) -> str:
        return os.path.join(self.state, f"round-{number:05d}")

    def _lists(self, number: int) -> list[str]:
        try:
            return sorted(n for n in os.listdir(self._round(number)) if n.endswith(".json"))
        except FileNotFoundError:
            return []

    def _position(self) -> dict:
        """Where the last planned micro-batch ends."""
        path = os.path.join(self.state, "position.json")
        if not os.path.isfile(path):
            _put(os.path.join(self._round(0), "0.json"), [self.root])
            _put(path, self.initialOffset())
        return _get(path)

    def initialOffset(self) -> dict:
        return {"round": 0, "at": 0}

    def latestOffset(self) -> dict:
        """The end of the next micro-batch. It is asked for when the one before is done, and the round's lists are then
        there; while the gate is shut it is where the stream stands, and nothing is read."""
        now = self._position()
        if self.gate and self.gate.state != "open":
            return now
        number, at, lists = now["round"], now["at"], self._lists(now["round"])
        if at >= len(lists):
            number, at, lists = number + 1, 0, self._lists(number + 1)
            if not lists:
                _put(os.path.join(self.state, "exhausted.json"), now)
                return now
        return {"round": number, "at": min(at + self.step, len(lists))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        _put(os.path.join(self.state, "position.json"), end)
        first = start["at"] if start["round"] == end["round"] else 0
        return [FolderList(end["round"], name) for name in self._lists(end["round"])[first : end["at"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        todo, listed = deque(_get(os.path.join(self._round(partition.number), partition.list_name))), 0
        while todo and listed < DUTY:
            if self.gate:
                self.gate.wait()
            folders, files = list_folder(todo.popleft(), self.base, self.fy, self.bank)
            todo.extend(folders)
            listed += 1
            yield from files
        left, stem = list(todo), partition.list_name.removesuffix(".json")
        for k in range(0, len(left), FOLDERS):
            _put(os.path.join(self._round(partition.number + 1), f"{stem}-{k // FOLDERS:06d}.json"), left[k : k + FOLDERS])


def exhausted(state: str) -> bool:
    """Whether the tree is listed to its end."""
    return os.path.isfile(os.path.join(state, "exhausted.json"))


def read_tree(spark: SparkSession, root: str, state: str, settings: Settings, gate: str | None = None, lists: int = LISTS):
    """The stream of the files in the settings' scope below ``root``."""
    spark.dataSource.register(FolderTree)
    reader = spark.readStream.format("folder_tree").options(root=root, state=state, base=settings.root, lists=lists)
    for name, value in (("fy", settings.fy_scope), ("bank", settings.bank_scope), ("gate", gate)):
        if value:
            reader = reader.option(name, value)
    return reader.load()
