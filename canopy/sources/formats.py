"""``fasta``, ``blast`` and ``pdb`` as formats of ``spark.read``, with byte ranges, chosen columns and pushed filters.

``register(spark)`` makes them known; then ``spark.read.format("fasta").load(path)``. A path is a file, a folder or a pattern, with or without the scheme of a store that Arrow's file systems reach; ``readers`` has the same tables through Spark's own text reader for any other store.

A file is cut into ranges of ``splitBytes``, and small files share a task. A record belongs to the range in which it begins and is read to its end, so that records across borders are whole and come once; ``.gz`` files are one range. ``.schema("id string, length long")`` chooses columns, and what isn't chosen isn't decoded. Comparisons and prefixes that are asked of single columns are taken in the reader: of a record whose header or field fails, the rest isn't decoded, and of ``file`` before tasks are made.
"""

from __future__ import annotations

import io
import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from canopy.sources.readers import RESIDUES

#: Bytes of a range, and what opening a file counts as, where small files share a task.
SPLIT_BYTES, OPEN_BYTES = 128 << 20, 4 << 20

_TESTS: dict[type, Callable] = {
    D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt,
    D.LessThanOrEqual: operator.le, D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: operator.contains,
    D.In: lambda value, among: value in among,
}


@dataclass
class Ranges(D.InputPartition):
    """Ranges ``(path, start, end)`` that one task reads; ``end`` is None for the whole file."""

    parts: list[tuple[str, int, int | None]]


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str, pattern: str) -> list[tuple[str, int]]:
    """Files at a path and their sizes, by name; hidden ones, and names that begin with ``_``, are left out."""
    from pyarrow import fs

    system, base = _system(path)
    scheme = path[: len(path) - len(base)] if path.endswith(base) else ""
    if any(c in base for c in "*?["):
        fixed = re.split(r"[*?\[]", base)[0].rpartition("/")[0]
        found = [i for i in system.get_file_info(fs.FileSelector(fixed or "/", recursive=True)) if fnmatch(i.path, base)]
    else:
        info = system.get_file_info(base)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
    below = len(base.rstrip("/"))
    kept = [i for i in found if i.is_file and fnmatch(i.base_name, pattern) and not re.search(r"(^|/)[._]", i.path[below:] if i.path.startswith(base) else i.base_name)]
    return sorted((scheme + i.path, i.size) for i in kept)


def _open(path: str):
    system, base = _system(path)
    return io.BufferedReader(system.open_input_stream(base) if path.endswith(".gz") else system.open_input_file(base), 1 << 20)


def _lines(path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """``(place, line)`` of lines from the first that begins at ``start`` or later on, beyond ``end`` as well; the caller stops."""
    with _open(path) as f:
        at = start
        if start:
            f.seek(start - 1)
            at += len(f.readline()) - 1
        for line in f:
            yield at, line
            at += len(line)


class _Reader(D.DataSourceReader):
    """Ranges and filters that the formats share. ``split``: whether a file may be cut."""

    split = True

    def __init__(self, options: Mapping[str, str], schema: T.StructType) -> None:
        self.options = options
        self.names = schema.fieldNames()
        self.tests: list[tuple[str, Callable, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, D.IsNotNull) and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], lambda value, _: value is not None, None))
            elif type(f) in _TESTS and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], _TESTS[type(f)], f.value))
            else:
                yield f

    def holds(self, name: str, value: object) -> bool:
        """Whether a row with this value of the column can be in the result; null passes ``IS NULL`` only, which isn't taken here."""
        return all(value is not None and test(value, than) for column, test, than in self.tests if column == name)

    def needs(self, *names: str) -> bool:
        return any(n in self.names for n in names) or any(c in names for c, _, _ in self.tests)

    def partitions(self) -> list[Ranges]:
        path = self.options.get("path")
        if not path:
            raise ValueError("load() needs a path")
        most = int(self.options.get("splitBytes", SPLIT_BYTES))
        if most < 1:
            raise ValueError("splitBytes is at least 1")
        found = _files(path, self.options.get("pathGlobFilter", "*"))
        if not found:
            raise FileNotFoundError(f"no files at {path}")
        out, held = [], most
        for name, size in found:
            if not self.holds("file", name):
                continue
            cut = self.split and not name.endswith(".gz")
            for start in range(0, size, most) if cut else [0]:
                end = min(start + most, size) if cut else None
                cost = (end - start if cut else size) + OPEN_BYTES
                if held + cost > most + OPEN_BYTES or not out:
                    out.append(Ranges([]))
                    held = 0
                out[-1].parts.append((name, start, end))
                held += cost
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for path, start, end in partition.parts:
            yield from self.rows(path, start, end)

    def rows(self, path: str, start: int, end: int | None) -> Iterator[tuple]:
        raise NotImplementedError


class _Fasta(_Reader):
    def rows(self, path: str, start: int, end: int | None) -> Iterator[tuple]:
        whole = self.needs("sequence")
        count = whole or self.needs("length")
        now, kept = None, []

        def record() -> tuple | None:
            if now is None:
                return None
            if count:
                now["length"] = sum(map(len, kept))
                if not self.holds("length", now["length"]):
                    return None
            if whole:
                now["sequence"] = b"".join(kept).decode("utf-8", "replace").upper()
                now["length"] = len(now["sequence"])
                if not self.holds("sequence", now["sequence"]):
                    return None
            return tuple(now[n] for n in self.names)

        for at, line in _lines(path, start, end):
            if line.startswith(b">"):
                if (row := record()) is not None:
                    yield row
                now, kept = None, []
                if end is not None and at >= end:
                    return
                head = line[1:].decode("utf-8", "replace").strip().split(None, 1)
                made = {"id": head[0] if head else "", "description": head[1] if len(head) > 1 else "", "file": path, "at": at}
                if all(self.holds(n, v) for n, v in made.items()):
                    now = made
            elif now is None:
                if end is not None and at >= end:
                    return
            elif count:
                kept.append(line.strip())
        if (row := record()) is not None:
            yield row


_NUMBERS = ("pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore")


def _number(text: bytes) -> float | None:
    try:
        return None if b"_" in text else float(text)
    except ValueError:
        return None


class _Blast(_Reader):
    def rows(self, path: str, start: int, end: int | None) -> Iterator[tuple]:
        wanted = [(i, n) for i, n in enumerate(("query", "subject", *_NUMBERS)) if self.needs(n)]
        for at, line in _lines(path, start, end):
            if end is not None and at >= end:
                return
            if line.startswith(b"#"):
                continue
            fields = line.rstrip(b"\r\n").split(b"\t")
            if len(fields) < 12:
                continue
            now: dict[str, object] = {"file": path, "at": at}
            for i, n in wanted:
                now[n] = fields[i].decode("utf-8", "replace").strip() if i < 2 else _number(fields[i])
                if not self.holds(n, now[n]):
                    break
            else:
                if self.holds("at", at) and self.holds("file", path):
                    yield tuple(now[n] for n in self.names)


class _Pdb(_Reader):
    split = False

    def rows(self, path: str, start: int, end: int | None) -> Iterator[tuple]:
        chain = self.options.get("chain")
        atoms = self.needs("sequence", "length", "mean_bfactor", "frac_high", "frac_low")
        code, letters, factors = "", [], []
        for _, line in _lines(path, start, end):
            if line.startswith(b"HEADER") and not code:
                code = line[62:66].decode("utf-8", "replace").strip()
                if code and not self.holds("id", code):
                    return
                if code and not atoms:
                    break
            elif atoms and line.startswith(b"ATOM") and line[12:16].strip() == b"CA":
                letter = RESIDUES.get(line[17:20].decode("ascii", "replace").strip())
                if letter and (chain is None or line[21:22].decode("ascii", "replace") == chain):
                    letters.append(letter)
                    b = _number(line[60:66])
                    if b is not None:
                        factors.append(b)
        n = len(factors)
        now = {
            "file": path, "id": code or re.sub(r"\.[^.]*$", "", path.rpartition("/")[2]), "sequence": "".join(letters), "length": len(letters),
            "mean_bfactor": sum(factors) / n if n else None, "frac_high": sum(b > 90 for b in factors) / n if n else None, "frac_low": sum(b < 50 for b in factors) / n if n else None,
        }
        if all(self.holds(c, v) for c, v in now.items()):
            yield tuple(now[c] for c in self.names)


class _Source(D.DataSource):
    """A format: its columns, those read where none are chosen, and its reader."""

    columns = ""
    usual = ""
    reads: type[_Reader]

    def schema(self) -> str:
        return self.usual

    def reader(self, schema: T.StructType) -> _Reader:
        known = dict(c.replace("long", "bigint").split() for c in self.columns.split(", "))
        for f in schema.fields:
            if known.get(f.name) != f.dataType.simpleString():
                raise ValueError(f"{self.name()} has no column {f.name} {f.dataType.simpleString()}; it has {self.columns}")
        return self.reads(self.options, schema)


class FastaSource(_Source):
    """A record for each line that begins with ``>``. ``id`` is its first word ("" without one), ``description`` the rest; letters are upper-cased, and lines before the first record are no record. ``at``: the byte where it begins."""

    columns = "id string, description string, sequence string, length long, file string, at long"
    usual = "id string, sequence string"
    reads = _Fasta

    @classmethod
    def name(cls) -> str:
        return "fasta"


class BlastSource(_Source):
    """A row for each line of tabular output of twelve fields or more; comments and shorter lines are none, and numbers that can't be read are null. ``(file, at)`` is the order of lines."""

    columns = "query string, subject string, " + ", ".join(f"{n} double" for n in _NUMBERS) + ", file string, at long"
    usual = columns
    reads = _Blast

    @classmethod
    def name(cls) -> str:
        return "blast"


class PdbSource(_Source):
    """A row for each file; the columns are those of ``readers.read_pdb``, null fractions where no alpha carbon has a B-factor. Option ``chain``."""

    columns = "file string, id string, sequence string, length int, mean_bfactor double, frac_high double, frac_low double"
    usual = columns
    reads = _Pdb

    @classmethod
    def name(cls) -> str:
        return "pdb"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastaSource, BlastSource, PdbSource):
        spark.dataSource.register(source)
