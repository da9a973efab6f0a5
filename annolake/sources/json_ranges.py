"""Annotation documents of any size as a Spark data source: records read by byte ranges, documents written by many tasks.

A document is a JSON object with named arrays of records. Reading takes two passes over byte ranges. The first one doesn't
know whether its range begins inside a string, so it sums the range up for both cases: change of depth, state at its
end, and for every depth below or above the start the last key and the last opened bracket. The summaries, one small row
for each range, are composed in order; then every range knows its state, depth and array, and the second pass gives the
records that begin in it. A record is read to its end, wherever that lies; nothing longer than a range and a record is held.

Writing: rows come range-partitioned and sorted by (set, section, id). Every task writes its part of the text; the commit,
which sees where all parts begin and end, adds the brackets, commas and empty arrays between them as small files. The
files of a folder named *.json, in the order of their names, are one document; with `single` they become one file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from annolake.sources.ranges import Staged, file_system

#: The named parts of a document, in the order in which they are written; the first holds one record, the others arrays.
SECTIONS = ("info", "images", "categories", "annotations")
#: Bytes of a range; of a read beyond it; of an output batch.
RANGE, AHEAD, BATCH_BYTES = 8 << 20, 1 << 16, 4 << 20
_QUOTE, _BACKSLASH, _COLON = 0x22, 0x5C, 0x3A
_BRACKETS = np.zeros(256, np.int8)
_BRACKETS[[ord("{"), ord("[")]], _BRACKETS[[ord("}"), ord("]")]] = 1, -1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True


@dataclass
class Document:
    """Files that follow one another as one text."""

    name: str
    root: str
    files: list[tuple[str, int]]
    size: int = field(init=False)

    def __post_init__(self):
        self.size = sum(n for _, n in self.files)

    def read(self, start: int, stop: int) -> bytes:
        """The bytes from start to stop, or to the end."""
        system, out, at = file_system(self.root)[0], [], 0
        for path, n in self.files:
            lo, hi = max(start - at, 0), min(stop - at, n)
            if lo < hi:
                with system.open_input_file(path) as f:
                    f.seek(lo)
                    out.append(f.read(hi - lo))
            at += n
            if at >= stop:
                break
        return b"".join(out)


def documents_of(paths: list[str]) -> list[Document]:
    """A file is a document, and so is a folder named *.json; of another folder all that lies in it."""
    out = []
    for path in paths:
        system, at = file_system(path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            out.append(Document(at, path, [(at, info.size)]))
            continue
        inside = sorted(system.get_file_info(fs.FileSelector(at)), key=lambda f: f.path)
        inside = [f for f in inside if not f.base_name.startswith(("_", "."))]
        if at.endswith(".json"):
            out.append(Document(at, path, [(f.path, f.size) for f in inside if f.type == fs.FileType.File]))
        else:
            base = path.rstrip("/")
            for f in inside:
                out += documents_of([f"{base}/{f.base_name}"])
    return out


class Structure:
    """Where strings, keys and brackets lie in a piece of JSON that begins inside a string or not, and after a backslash or not."""

    def __init__(self, data: bytes, in_string: bool, escaped: bool):
        b = np.frombuffer(data, np.uint8)
        self.bytes = b
        slash = np.flatnonzero(b == _BACKSLASH)
        new = np.append(True, np.diff(slash) != 1)[: len(slash)]
        first = slash[new]
        length = np.diff(np.append(np.flatnonzero(new), len(slash)))  # of each run of backslashes
        if escaped and len(first) and first[0] == 0:
            length[0] -= 1  # that backslash stands for itself
        run = np.diff(np.append(np.flatnonzero(new), len(slash)))
        self.escaped_after = bool(len(run) and first[-1] + run[-1] == len(b) and length[-1] % 2) if len(b) else escaped
        hidden = (first + run)[length % 2 == 1]
        quotes = np.flatnonzero(b == _QUOTE)
        quotes = quotes[~np.isin(quotes, hidden)]
        if escaped and len(quotes) and quotes[0] == 0:
            quotes = quotes[1:]
        self.quotes, self.in_string = quotes, in_string
        self.in_string_after = bool(in_string ^ (len(quotes) & 1))
        at = np.flatnonzero(_BRACKETS[b])
        at = at[~self.inside(at)]
        self.at, self.step = at, _BRACKETS[b[at]].astype(np.int64)
        self.depth = np.cumsum(self.step)  # after each bracket, counted from the piece's start
        self.opening = quotes[int(in_string) :: 2]

    def inside(self, places: np.ndarray) -> np.ndarray:
        """Whether places lie in strings."""
        return (np.searchsorted(self.quotes, places) & 1).astype(bool) ^ self.in_string

    def depth_at(self, places: np.ndarray) -> np.ndarray:
        """Depth before each place, counted from the piece's start."""
        i = np.searchsorted(self.at, places)
        return np.where(i > 0, self.depth[np.maximum(i, 1) - 1], 0) if len(self.at) else np.zeros(len(places), np.int64)


def _keys(doc: Document, start: int, data: bytes, s: Structure) -> tuple[np.ndarray, list[bytes]]:
    """(places of opening quotes, names) of the strings that begin in the piece and are followed by a colon, which may lie beyond it."""
    opens, closes = s.opening, s.quotes[1 + int(s.in_string) :: 2]
    tail, reach = b"", AHEAD
    while len(opens) and start + len(data) + len(tail) < doc.size:
        # The last string, or what follows it, may go on beyond the piece: look ahead to the next token.
        last = Structure(data[opens[-1] :] + tail, False, False)
        if len(last.quotes) > 1 and np.any(~_SPACE[last.bytes[last.quotes[1] + 1 :]]):
            break
        place = start + len(data) + len(tail)
        tail, reach = tail + doc.read(place, place + reach), 2 * reach
    text = np.frombuffer(data + tail, np.uint8)
    if len(closes) < len(opens):
        whole = Structure(data[opens[-1] :] + tail, False, False)
        closes = np.append(closes, opens[-1] + whole.quotes[1]) if len(whole.quotes) > 1 else closes
        opens = opens[: len(closes)]
    if not len(opens):
        return opens, []
    solid = np.flatnonzero(~_SPACE[text])
    after = np.searchsorted(solid, closes, side="right")
    ok = (after < len(solid)) & (text[solid[np.minimum(after, len(solid) - 1)]] == _COLON)
    joined = data + tail
    return opens[ok], [joined[a + 1 : b] for a, b in zip(opens[ok], closes[ok], strict=True)]


def _escaped_before(doc: Document, start: int) -> bool:
    """Whether an odd number of backslashes ends right before start."""
    n, reach = 0, 64
    while start > n:
        data = doc.read(max(0, start - reach), start)
        n = len(data) - len(data.rstrip(b"\\"))
        if n < len(data) or reach >= start:
            break
        reach *= 16
    return n % 2 == 1


def summarize(doc: Document, start: int, stop: int) -> list[dict]:
    """The range for both states it may begin in: change of depth, state after, and by relative depth the last key, the bracket that came last after it, and the sections named."""
    data, escaped, out = doc.read(start, stop), _escaped_before(doc, start), []
    for in_string in (False, True):
        s = Structure(data, in_string, escaped)
        places, names = _keys(doc, start, data, s)
        depths = s.depth_at(places)
        opened = np.flatnonzero(s.step > 0)
        levels = {}
        for d in np.unique(np.concatenate([depths, s.depth[opened] - 1])).tolist():
            own = np.flatnonzero(depths == d)
            brackets = opened[s.depth[opened] - 1 == d]
            last = names[own[-1]].decode("utf-8", "replace")[:64] if len(own) else None
            late = len(brackets) and (not len(own) or s.at[brackets[-1]] > places[own[-1]])
            kind = chr(s.bytes[s.at[brackets[-1]]]) if late else None
            levels[d] = [last, kind, sorted({names[i].decode("utf-8", "replace") for i in own} & set(SECTIONS))]
        out.append({"delta": int(s.depth[-1]) if len(s.depth) else 0, "in_string": s.in_string_after, "levels": levels})
    return out


@dataclass
class _Range(InputPartition):
    doc: Document
    start: int
    stop: int
    depth: int = 0
    in_string: bool = False
    section: str | None = None
    bracket: str | None = None


def records_of(part: _Range, wanted: set[str]) -> Iterator[tuple[str, int, bytes]]:
    """(section, offset, text) of the records that begin in the range."""
    doc, data = part.doc, part.doc.read(part.start, part.stop)
    s = Structure(data, part.in_string, _escaped_before(doc, part.start))
    places, names = _keys(doc, part.start, data, s)
    top = np.flatnonzero(s.depth_at(places) + part.depth == 1)
    key_at, key_name = places[top], [names[i].decode("utf-8", "replace") for i in top]
    depth, before = s.depth + part.depth, s.depth + part.depth - s.step
    opened = np.flatnonzero(s.step > 0)
    outer = opened[before[opened] == 1]  # brackets of the top-level values
    own = opened[(s.bytes[s.at[opened]] == ord("{")) & ((before[opened] == 2) | (before[opened] == 1))]
    ends = {d: np.flatnonzero((depth == d) & (s.step < 0)) for d in (1, 2)}
    for i in own:
        place, level = s.at[i], int(before[i])
        k = int(np.searchsorted(key_at, place)) - 1
        section = key_name[k] if k >= 0 else part.section
        if section not in wanted or (level == 1 and section != SECTIONS[0]):
            continue
        if level == 2:
            j = int(np.searchsorted(outer, i)) - 1
            if (chr(s.bytes[s.at[outer[j]]]) if j >= 0 else part.bracket) != "[":
                continue
        e = int(np.searchsorted(ends[level], i))
        if e < len(ends[level]):
            yield section, part.start + int(place), data[place : s.at[ends[level][e]] + 1]
            continue
        rest, deep, state, at = [data[place:]], int(depth[-1]), s, part.stop
        while at < doc.size:
            more = doc.read(at, at + AHEAD)
            state = Structure(more, state.in_string_after, state.escaped_after)
            hit = np.flatnonzero(state.depth + deep == level)
            if len(hit):
                rest.append(more[: state.at[hit[0]] + 1])
                yield section, part.start + int(place), b"".join(rest)
                break
            rest.append(more)
            deep += int(state.depth[-1]) if len(state.depth) else 0
            at += len(more)
        else:
            raise ValueError(f"{doc.name}: the record at byte {part.start + int(place)} does not end")


def compose(found: dict[tuple[str, int], list[dict]], docs: list[Document], size: int) -> list[dict]:
    """Each range with the state it begins in and the sections that it may hold records of."""
    plan = []
    for doc in docs:
        depth, in_string, section, bracket = 0, False, None, None
        for start in range(0, doc.size, size):
            own = found[(doc.name, start)][int(in_string)]
            levels = {int(k): v for k, v in own["levels"].items()}
            last, kind, names = levels.get(1 - depth, [None, None, []])
            plan.append({"doc": doc.name, "start": start, "depth": depth, "in_string": in_string, "section": section, "bracket": bracket, "names": sorted({*names, *([section] if section in SECTIONS else [])})})
            if last is not None:
                section, bracket = last, kind
            elif kind is not None:
                bracket = kind
            depth, in_string = depth + own["delta"], own["in_string"]
        if depth or in_string:
            raise ValueError(f"{doc.name} is no whole JSON document")
    return plan


class JsonReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.size, self.plan = json.loads(options["paths"]), int(options.get("range_bytes", RANGE)), json.loads(options.get("plan", "null"))
        self.sections = set(json.loads(options.get("sections", json.dumps(SECTIONS))))

    def partitions(self):
        docs = {d.name: d for d in documents_of(self.paths)}
        if self.plan is None:
            parts = [_Range(d, start, min(start + self.size, d.size)) for d in docs.values() for start in range(0, d.size, self.size)]
        else:
            parts = [_Range(d, r["start"], min(r["start"] + self.size, d.size), r["depth"], r["in_string"], r["section"], r["bracket"]) for r in self.plan if self.sections & set(r["names"]) for d in [docs[r["doc"]]]]
        return parts or [_Range(Document("", "", []), 0, 0)]

    def read(self, partition: _Range):
        if not partition.doc.size:
            return
        if self.plan is None:
            yield partition.doc.name, partition.start, json.dumps(summarize(partition.doc, partition.start, partition.stop))
            return
        rows, held = [], 0
        names = pa.schema([("document", pa.string()), ("section", pa.string()), ("offset", pa.int64()), ("value", pa.string())])
        for section, offset, text in records_of(partition, self.sections):
            rows.append({"document": partition.doc.name, "section": section, "offset": offset, "value": text.decode("utf-8")})
            held += len(text)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=names)


def between(last: int, following: int) -> str:
    """The text between a record of section `last` (-1: the document's start) and one of section `following` (beyond the last: its end)."""
    if last == following:
        return ","
    out = "{" if last < 0 else "]" if last else ""
    for k in range(last + 1, min(following + 1, len(SECTIONS))):
        out += ("," if k else "") + f'"{SECTIONS[k]}":' + ("[" if k else "")
        if k < following:
            out += "]" if k else "null"
    return out + ("}" if following == len(SECTIONS) else "")


@dataclass
class _Fragment:
    """A task's part of one set: its file, and the sections and ids that it begins and ends with."""

    set_name: str
    file: str
    first: tuple
    last: int


@dataclass
class _Fragments(WriterCommitMessage):
    parts: list[_Fragment]


class JsonWriter(DataSourceArrowWriter):
    """Rows (set_name string, section int, id long, value string), range-partitioned and sorted by the first three."""

    def __init__(self, options, overwrite: bool):
        self.staged, self.overwrite, self.single = Staged(options["path"]), overwrite, options.get("single", "false").lower() == "true"

    def write(self, iterator):
        parts, stream = [], None
        for batch in iterator:
            for name, section, ident, value in zip(*(batch.column(c).to_pylist() for c in ("set_name", "section", "id", "value")), strict=True):
                if not parts or parts[-1].set_name != name:
                    if stream is not None:
                        stream.close()
                    file, stream = self.staged.open(".json")
                    parts.append(_Fragment(name, file, (section, ident is not None, ident or 0), section))
                else:
                    stream.write(between(parts[-1].last, section).encode())
                    parts[-1].last = section
                stream.write(value.encode())
        if stream is not None:
            stream.close()
        return _Fragments(parts)

    def commit(self, messages):
        if self.overwrite:
            self.staged.clear()
        sets: dict[str, list[_Fragment]] = {}
        for m in messages:
            for f in m.parts if m is not None else []:
                sets.setdefault(f.set_name, []).append(f)
        for name, parts in sets.items():
            pieces, last = [], -1
            for f in sorted(parts, key=lambda f: f.first):
                pieces += [self._small(between(last, f.first[0])), f.file]
                last = f.last
            pieces.append(self._small(between(last, len(SECTIONS))))
            if self.single:
                self.staged.move(self._joined(pieces), f"{name}.json")
                continue
            for i, piece in enumerate(pieces):
                self.staged.move(piece, f"{name}.json/part-{i:07d}.json")
        self.staged.end()

    def _small(self, text: str) -> str:
        name, stream = self.staged.open(".json")
        stream.write(text.encode())
        stream.close()
        return name

    def _joined(self, pieces: list[str]) -> str:
        """One file of all pieces, copied in blocks of bounded size."""
        system, at = file_system(self.staged.path)
        name, stream = self.staged.open(".json")
        for piece in pieces:
            with system.open_input_file(f"{at}/{self.staged.job}/{piece}") as f:
                while data := f.read(AHEAD * 16):
                    stream.write(data)
        stream.close()
        return name

    def abort(self, messages):
        self.staged.end()


class JsonSource(DataSource):
    """Format `annotation_json`. Reading without `plan` gives the summaries of ranges, with it the records of `sections`."""

    @classmethod
    def name(cls):
        return "annotation_json"

    def schema(self):
        return "document string, start long, summary string" if "plan" not in self.options else "document string, section string, offset long, value string"

    def reader(self, schema):
        return JsonReader(self.options)

    def writer(self, schema, overwrite):
        return JsonWriter(self.options, overwrite)


def read_records(spark: SparkSession, paths: list[str], range_bytes: int = RANGE):
    """A function from sections to (document, section, offset, value) of their records; ranges without records of them are not read."""
    docs = documents_of(paths)
    spark.dataSource.register(JsonSource)
    reader = lambda: spark.read.format("annotation_json").option("paths", json.dumps(paths)).option("range_bytes", range_bytes)
    found = {(r.document, r.start): json.loads(r.summary) for r in reader().load().collect()}  # a small row for each range
    plan = json.dumps(compose(found, docs, range_bytes))

    def records(*sections: str) -> DataFrame:
        return reader().option("plan", plan).option("sections", json.dumps(sections or SECTIONS)).load()

    return records


def write_documents(rows: DataFrame, path: str, single: bool = False) -> None:
    """rows (set_name, section, id, value) as one document for each set below path."""
    rows.sparkSession.dataSource.register(JsonSource)
    keys = ["set_name", "section", "id"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.select(*keys, "value").repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.format("annotation_json").mode("overwrite").option("single", str(single).lower()).save(path)
