"""Several folders changed in one step: whole versions, and a numbered log of which one counts."""

from __future__ import annotations

import json
import uuid

from ledgerloom.sources.files import Files


class Versions:
    """``versions/ID/...`` holds data that nobody changes, ``commits/NUMBER.json`` names a version.

    A reader takes the commit with the highest number, once, and reads that version's folders only.
    A commit appears whole under a number that no other writer has, so whatever breaks off, readers
    see one version or the other. Of two writers the later commit wins.
    """

    def __init__(self, files: Files, folder: str):
        self.files = files
        self.folder = folder.rstrip("/")

    def begin(self) -> str:
        """The folder for a new version; unseen until it is committed."""
        return f"{self.folder}/versions/{uuid.uuid4().hex}"

    def _numbers(self) -> list[int]:
        names = self.files.names(f"{self.folder}/commits")
        return [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]

    def _read(self, number: int) -> dict:
        return json.loads(self.files.read_marker(f"{self.folder}/commits/{number:020d}.json"))

    def commit(self, version: str, **about) -> int:
        """Make ``version`` the one that readers see; its number."""
        entry = {"version": version.rsplit("/", 1)[-1], **about}
        number = max(self._numbers(), default=0) + 1
        while not self.files.put_new(f"{self.folder}/commits/{number:020d}.json", json.dumps(entry)):
            number += 1
        return number

    def current(self) -> dict | None:
        """The newest commit with ``path``, its version's folder; None before the first."""
        numbers = self._numbers()
        if not numbers:
            return None
        entry = self._read(max(numbers))
        return {**entry, "number": max(numbers), "path": f"{self.folder}/versions/{entry['version']}"}

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the ``keep`` newest commits and the versions that only those named.

        Versions without a commit stay: they may be somebody's run under way.
        """
        numbers = sorted(self._numbers())
        old, new = numbers[:-keep], numbers[-keep:]
        named = {self._read(n)["version"] for n in new}
        for number in old:
            version = self._read(number)["version"]
            if version not in named:
                self.files.remove(f"{self.folder}/versions/{version}")
            self.files.remove(f"{self.folder}/commits/{number:020d}.json")
