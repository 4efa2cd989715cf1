"""A data source that reads the elements of arrays inside one large JSON document by byte ranges.

A document is an object with arrays among its members, of any size, on one line or many.  Its
bytes are cut into ranges, which are read three times, each time by all tasks:

1. A range doesn't know whether it begins inside a string.  It counts brackets and quotes for either case.
2. Summaries put one after the other say how each range really begins: in a string or not, and how
   deep.  Now each tells the last array or object that it opens below the root, and how many elements
   begin in it after that.
3. So each range knows the array it begins in and the number of its first element, and gives the
   elements whose border (the bracket or comma before them) lies in it, reading on to the end of the last.

What is between arrays, a few members, comes as pieces that make up the document without
its elements.  Only a summary of fixed size for each range goes through the driver, and ranges are no more
than ``MOST_RANGES``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES, MOST_RANGES, BLOCK_BYTES = 32 << 20, 20_000, 4 << 20

_QUOTE, _BACK, _COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[0x7B, 0x5B]], _STEP[[0x7D, 0x5D]] = 1, -1


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def documents(path: str, suffix: str) -> list[tuple[str, int]]:
    """Address and size of each document under ``path``, in the order of their names."""
    from pyarrow import fs

    system, root = _system(path)
    head = path[: len(path) - len(root)] if path.endswith(root) else "file://"
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    listed = [(f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(suffix) and not any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p)]
    return [(head + p, n) for p, n in sorted(listed)]


@dataclass
class Range(InputPartition):
    file: str
    ord: int
    number: int
    begin: int
    end: int
    size: int
    start: dict | None = None


def _escaped(data: np.ndarray, before: bool) -> np.ndarray:
    """Which bytes follow an odd number of backslashes; ``before``: the first byte does."""
    plain = np.where(data != _BACK, np.arange(len(data)), -1)
    last = np.maximum.accumulate(plain) if len(data) else plain
    run = np.arange(len(data)) - last  # backslashes up to here, this one included
    run[last < 0] += before
    out = np.empty(len(data), bool)
    out[:1], out[1:] = before, run[:-1] % 2 == 1
    return out


class _Walk:
    """Bytes from an offset on, block by block, with the tokenizer's state kept between blocks."""

    def __init__(self, stream, begin: int, end: int, inside: bool, depth: int, block: int) -> None:
        self.stream, self.at, self.end, self.inside, self.depth, self.block = stream, begin, end, inside, depth, block
        back = 64
        while begin:  # a run of backslashes may have begun before
            stream.seek(max(0, begin - back))
            some = stream.read(min(back, begin))
            run = len(some) - len(some.rstrip(b"\\"))
            if run < len(some) or len(some) == begin:
                break
            back *= 2
        self.after_back = bool(begin) and run % 2 == 1

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(offset, bytes, which of them are inside strings, depth after each)."""
        while self.at < self.end:
            self.stream.seek(self.at)
            data = np.frombuffer(self.stream.read(min(self.block, self.end - self.at)), np.uint8)
            if not len(data):
                raise ValueError("the document ends too early")
            escaped = _escaped(data, self.after_back)
            quote = (data == _QUOTE) & ~escaped
            upto = np.cumsum(quote) + self.inside
            inside = (upto - quote) % 2 == 1  # a quote that opens is outside, one that closes inside
            depth = self.depth + np.cumsum(np.where(inside | quote, 0, _STEP[data]), dtype=np.int64)
            yield self.at, data, inside | quote, depth
            self.at += len(data)
            self.inside, self.depth = bool(upto[-1] % 2), int(depth[-1])
            self.after_back = data[-1] == _BACK and not escaped[-1]


def _borders(data: np.ndarray, inside: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Places of what opens, parts or closes the members of the root's members."""
    step = np.where(inside, 0, _STEP[data])
    opens, closes = (step == 1) & (depth == 2), (step == -1) & (depth == 1)
    return np.flatnonzero(opens | closes | ((data == _COMMA) & ~inside & (depth == 2)))


class RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.phase = options["path"], options.get("phase", "states")
        self.suffix = options.get("suffix", ".json").lower()
        self.range_bytes, self.block = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("blockBytes", BLOCK_BYTES))
        self.plan = json.loads(options["plan"]) if "plan" in options else {}

    def partitions(self):
        found = documents(self.path, self.suffix)
        width = max(self.range_bytes, -(-sum(n for _, n in found) // MOST_RANGES))
        out = []
        for order, (file, size) in enumerate(found):
            for number, begin in enumerate(range(0, size, width)):
                out.append(Range(file, order, number, begin, min(begin + width, size), size, self.plan.get(f"{order}/{number}")))
        return out or [Range("", -1, 0, 0, 0, 0)]

    def read(self, partition):
        if partition.ord < 0:
            return
        system, path = _system(partition.file)
        with system.open_input_file(path) as stream:
            run = {"states": self._states, "opened": self._opened, "elements": self._elements}[self.phase]
            for kind, key, pos, text in run(stream, partition):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.ord] * len(text), pa.int32()), pa.array([partition.number] * len(text), pa.int32()), pa.array([kind] * len(text)), pa.array(key, pa.string()), pa.array(pos, pa.int64()), pa.array(text, pa.binary())],
                    ["snapshot_ord", "range", "kind", "key", "pos", "data"],
                )

    def _states(self, stream, part: Range):
        walk, delta, other = _Walk(stream, part.begin, part.end, False, 0, self.block), 0, 0
        for _, data, inside, depth in walk.blocks():
            delta = int(depth[-1])
            # inside and outside change places if the range begins inside a string; quotes count for neither
            other += int(_STEP[data[inside]].sum())
        yield "states", [part.file], [part.begin], [json.dumps({"flips": walk.inside, "outside": delta, "inside": other, "last": part.end == part.size}).encode()]

    def _opened(self, stream, part: Range):
        start = part.start
        walk, opened, parts = _Walk(stream, part.begin, part.end, start["inside"], start["depth"], self.block), None, 0
        for at, data, inside, depth in walk.blocks():
            borders = _borders(data, inside, depth)
            opens = borders[_STEP[data[borders]] == 1]
            if len(opens):
                opened, borders = at + int(opens[-1]), borders[borders > opens[-1]]
                parts = 0
            parts += int((data[borders] == _COMMA).sum())
        told = {"opened": None if opened is None else self._name(stream, opened), "parts": parts}
        yield "opened", [part.file], [part.begin], [json.dumps(told).encode()]

    @staticmethod
    def _name(stream, at: int) -> str:
        """The name before the bracket at ``at``, with the bracket in front; read backwards."""
        back = 256
        while True:
            begin = max(0, at - back)
            stream.seek(begin)
            head = stream.read(at - begin + 1)
            bracket, rest = chr(head[-1]), head[:-1].rstrip()
            if rest.endswith(b":") and (rest := rest[:-1].rstrip()).endswith(b'"'):
                # the quote that opens the name is the last one before it that no backslash escapes
                data = np.frombuffer(rest[:-1], np.uint8)
                quotes = np.flatnonzero((data == _QUOTE) & ~_escaped(data, False))
                if len(quotes) and (quotes[-1] > 64 or not begin):
                    return bracket + json.loads(rest[quotes[-1] :])
            if not begin:
                raise ValueError("a bracket without a name below the root")
            back *= 4

    def _elements(self, stream, part: Range):
        start = part.start
        key, count = start["key"], start["count"]
        array = bool(key) and key[0] == "["
        walk = _Walk(stream, part.begin, part.size, start["inside"], start["depth"], self.block)
        pending: list[bytes] | None = None  # of an element whose border lies in this range
        texts, keys, numbers, shell, done = [], [], [], [], False
        for at, data, inside, depth in walk.blocks():
            begin = 0
            for b in [*_borders(data, inside, depth).tolist(), len(data)]:
                if pending is not None:
                    pending.append(data[begin:b].tobytes())
                elif not array:
                    shell.append(data[begin : max(begin, min(b, part.end - at))].tobytes())
                if b == len(data):
                    break
                begin, step = b + 1, int(_STEP[data[b]])
                if pending is not None:
                    text, pending = b"".join(pending).strip(), None
                    if text:
                        texts.append(text)
                        keys.append(key[1:])
                        numbers.append(count - 1)
                    elif step == 0 or count > 1:
                        raise ValueError(f"an empty element in {key[1:]}")
                if done := at + b >= part.end:
                    break
                if step == 1:
                    key = self._name(stream, at + b)
                    array, count = key[0] == "[", 0
                if not array or step:
                    shell.append(data[b : b + 1].tobytes())
                if step == -1:
                    array, key = False, None
                elif array:
                    pending, count = [], count + 1
            if sum(map(len, texts)) >= self.block:
                yield "element", keys, numbers, texts
                texts, keys, numbers = [], [], []
            if done or (pending is None and at + len(data) >= part.end):
                break
        if texts:
            yield "element", keys, numbers, texts
        if shell:
            yield "shell", [None], [part.begin], [b"".join(shell)]


class JsonRanges(DataSource):
    @classmethod
    def name(cls):
        return "json_ranges"

    def schema(self):
        return "snapshot_ord int, range int, kind string, key string, pos long, data binary"

    def reader(self, schema):
        return RangeReader(self.options)


def _composed(states: list, opened: dict) -> dict[str, dict]:
    """How each range begins, from the summaries of those before it."""
    plan, order, inside, depth, key, count = {}, None, False, 0, None, 0
    for row in sorted(states, key=lambda r: (r["snapshot_ord"], r["range"])):
        told = json.loads(row["data"])
        if row["snapshot_ord"] != order:
            order, inside, depth, key, count = row["snapshot_ord"], False, 0, None, 0
        place = f"{order}/{row['range']}"
        plan[place] = {"inside": inside, "depth": depth, "key": key if depth > 1 else None, "count": count}
        depth += told["inside"] if inside else told["outside"]
        inside ^= told["flips"]
        if depth < 0 or (told["last"] and (inside or depth)):
            raise ValueError(f"broken document: {row['key']}")
        here = opened.get(place)
        if here:
            key, count = (here["opened"], here["parts"] + 1) if here["opened"] else (key, count + here["parts"])
    return plan


def read(spark: SparkSession, path: str, suffix: str = ".json", range_bytes: int = RANGE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """snapshot_ord (documents in the order of their names), range, kind, key, pos, data.  Rows of kind
    ``element`` have the array's name, the number of the element and its text; those of kind ``shell``
    put together by range are the document without elements.  A document that is cut off or holds an
    empty element stops the job."""
    spark.dataSource.register(JsonRanges)

    def phase(name: str, plan: dict | None = None) -> DataFrame:
        reader = spark.read.format("json_ranges").option("phase", name).option("suffix", suffix).option("rangeBytes", range_bytes).option("blockBytes", block_bytes)
        return (reader if plan is None else reader.option("plan", json.dumps(plan))).load(path)

    states = phase("states").collect()  # a row a range
    plan = _composed(states, {})
    opened = {f"{r['snapshot_ord']}/{r['range']}": json.loads(r["data"]) for r in phase("opened", plan).collect()}
    return phase("elements", _composed(states, opened))
