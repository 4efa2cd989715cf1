"""Chat formatting over a prefix tree.

Conversations that share initial turns share those turns' tokens.  A node of the tree is a
path of turns, named by a chain of digests; each node is emitted once, by the first of the
conversations that pass through it.  The order of conversations is depth-first: each node's
subtree lies together, and begins with the conversation that emits the node.

Runs of that order are packed into sequences: a turn has its position ids (from the length of
its ancestors) and the intervals of the pack that it may attend to (its ancestors and itself).
A tree larger than a pack goes on in the next one; ancestors that were emitted in another
pack are there as segments without tokens, by digest, so no turn is repeated and no task
holds a whole tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import bloom
from heddle.llm.shared import written

# The template's control strings.
START, END, OPEN = "<|im_start|>", "<|im_end|>", "<|"
LOSS_ROLE = "assistant"
LOSS_HEAD = f"{START}{LOSS_ROLE}\n"
#: Code points of a pack.
PACK_TOKENS = 1 << 18

_CONTROL = re.compile(r"\\|<\|")
_ESCAPED = re.compile(r"\\([\\|])")


def escape(text: str) -> str:
    """No control string can appear in the result: ``\\`` is doubled, ``<|`` becomes ``<\\|``."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends (code points)."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
_ROLE = re.compile(r"\\([\\|n])")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation: the inverse of ``render``."""
    return [(_ROLE.sub(lambda r: "\n" if r[1] == "n" else r[1], m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


SEGMENT = "struct<node:int,parent:int,begin:int,stop:int,length:int,position:int,loss_begin:int,loss_stop:int,attends:array<struct<begin:int,stop:int>>,digest:binary>"
PACKS = f"pack string, tokens string, segments array<{SEGMENT}>, leaves array<struct<conversation:binary,node:int>>"
_INTS = ("node", "parent", "begin", "stop", "length", "position", "loss_begin", "loss_stop")
_PACKS = pa.schema(
    [
        ("pack", pa.string()),
        ("tokens", pa.string()),
        ("segments", pa.list_(pa.struct([(n, pa.int32()) for n in _INTS] + [("attends", pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))), ("digest", pa.binary())]))),
        ("leaves", pa.list_(pa.struct([("conversation", pa.binary()), ("node", pa.int32())]))),
    ]
)


class _Pack:
    """One sequence: code points are its tokens."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.size = 0
        self.segments: list[dict] = []
        self.leaves: list[dict] = []

    def add(self, parent: int, role: str, text: str, digest: bytes, here: bool) -> int:
        """A turn below the segment ``parent``; its tokens only if they belong ``here``."""
        shown, begin, stop = render(role, text)
        above = self.segments[parent] if parent >= 0 else None
        attends = [dict(x) for x in above["attends"]] if above else []
        own = {"begin": self.size, "stop": self.size + len(shown)} if here else {"begin": -1, "stop": -1}
        if here:
            # ancestors that lie together are one interval
            if attends and attends[-1]["stop"] == own["begin"]:
                attends[-1]["stop"] = own["stop"]
            else:
                attends.append(own)
            self.text.append(shown)
        position = above["position"] + above["length"] if above else 0
        loss = here and role == LOSS_ROLE
        at = {"loss_begin": self.size + begin if loss else -1, "loss_stop": self.size + stop if loss else -1}
        self.segments.append({"node": len(self.segments), "parent": parent, **own, "length": len(shown), "position": position, **at, "attends": attends, "digest": digest})
        self.size += len(shown) if here else 0
        return len(self.segments) - 1


def _packs(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, stack = _Pack(), []  # stack: (digest, node) from the root of the last conversation

        def done() -> pa.RecordBatch:
            name = hashlib.sha256(pack.leaves[0]["conversation"]).hexdigest()
            return pa.RecordBatch.from_pylist([{"pack": name, "tokens": "".join(pack.text), "segments": pack.segments, "leaves": pack.leaves}], _PACKS)

        for batch in batches:
            for row in batch.to_pylist():
                turns, nodes, start = row["turns"], row["nodes"], row["start"]
                grows = sum(len(t["role"]) + len(t["text"]) + 32 for t in turns[start:])
                # a pack ends before it would grow too long, and between trees once it is half full
                if pack.leaves and (pack.size + grows > limit or not start and pack.size > limit // 2):
                    yield done()
                    pack, stack = _Pack(), []
                shared = 0
                while shared < min(len(stack), len(nodes)) and stack[shared][0] == nodes[shared]:
                    shared += 1
                del stack[shared:]
                for d in range(shared, len(nodes)):
                    stack.append((nodes[d], pack.add(stack[-1][1] if stack else -1, turns[d]["role"], turns[d]["text"], nodes[d], d >= start)))
                pack.leaves.append({"conversation": row["conversation"], "node": stack[-1][1] if stack else -1})
        if pack.leaves:
            yield done()

    return run


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns (in order; null role or text: empty) and their digest.  Rows of equal
    turn go by role and text, null turns first."""
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    listed = grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return listed.withColumn("conversation", F.unhex(F.sha2(F.to_json("turns").cast("binary"), 256)))


def _placed(distinct: DataFrame) -> DataFrame:
    """``distinct`` (conversation, turns) with ``nodes`` (digests of its paths), ``start`` (how many
    of them other conversations emit) and ``order``.

    A node belongs to the conversation of smallest digest below it; those digests along a path,
    with its own at the end, order conversations depth-first."""
    step = lambda a, t: F.concat(a, F.array(F.unhex(F.sha2(F.concat(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(b"")), F.unhex(F.sha2(F.concat(t["role"], F.lit("\n"), t["text"]).cast("binary"), 256))), 256))))
    named = written(distinct.withColumn("nodes", F.aggregate("turns", F.array().cast("array<binary>"), step)), "paths")
    each = named.select("conversation", F.posexplode("nodes").alias("depth", "node"))
    # combines before the shuffle, so a turn that very many conversations begin with is a row a task
    first = written(each.groupBy("node").agg(F.min("conversation").alias("first")), "first-conversations")
    listed = each.join(first, "node").groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("depth", "first"))).alias("l"), F.count_if(F.col("first") != F.col("conversation")).cast("int").alias("start"))
    whole = named.join(listed, "conversation", "left")
    firsts = F.coalesce(F.transform("l", lambda x: x["first"]), F.array().cast("array<binary>"))
    return whole.select("conversation", "turns", "nodes", F.coalesce("start", F.lit(0)).alias("start"), F.concat(firsts, F.array("conversation")).alias("order"))


def pack(turns: DataFrame, pack_tokens: int = PACK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Format the conversations in ``turns`` (conv_id, turn, role, text).

    Returns ``(packs, members)``: packs as written in the shared folder (tokens, segments
    with positions, loss ranges and attention intervals, and the leaf of each distinct
    conversation), and for each conv_id the distinct conversation it is.  A null conv_id is a
    conversation of its own; an empty table gives empty results; a conversation longer than a
    pack is a pack by itself."""
    grouped = conversations_of(turns)
    members = written(grouped, "conversations")
    # equal conversations are one leaf
    distinct = members.groupBy("conversation").agg(F.first("turns").alias("turns"))
    ordered = _placed(distinct).repartitionByRange("order").sortWithinPartitions("order")
    packs = written(ordered.select("conversation", "turns", "nodes", "start").mapInArrow(_packs(pack_tokens), PACKS), "packs")
    return packs, members.select("conv_id", "conversation")


def _digest_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _nodes(sent):
    """(digest, shown) of emitted turns that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = [x for x in row["segments"] if x["begin"] >= 0]
                keys = np.array([_digest_key(x["digest"]) for x in own], np.int64).view(np.uint64)
                own = [own[i] for i in np.flatnonzero(bloom.holds(sent.value, keys))] if own else []
                yield pa.RecordBatch.from_arrays([pa.array([x["digest"] for x in own], pa.binary()), pa.array([row["tokens"][x["begin"] : x["stop"]] for x in own], pa.string())], ["digest", "shown"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_digest_key(d) for d in batch.column(0).to_pylist()], pa.int64())], ["key"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            out, tokens, segments = [], row["tokens"], row["segments"]
            elsewhere = {x["node"]: x["shown"] for x in row["elsewhere"] or ()}
            for leaf in row["leaves"]:
                chain, at = [], leaf["node"]
                while at >= 0:
                    x = segments[at]
                    shown = tokens[x["begin"] : x["stop"]] if x["begin"] >= 0 else elsewhere[at]
                    if x["loss_begin"] >= 0:
                        loss = tokens[x["loss_begin"] : x["loss_stop"]]
                    else:  # the loss mask of a turn in another pack is there; its text is the same
                        loss = shown[len(LOSS_HEAD) : -len(END) - 1] if x["begin"] < 0 and shown.startswith(LOSS_HEAD) else ""
                    chain.append((shown, unescape(loss)))
                    at = x["parent"]
                formatted, loss = "".join(x for x, _ in reversed(chain)), "".join(x for _, x in reversed(chain))
                turns = parse(formatted)
                out.append(
                    {
                        "conversation": leaf["conversation"],
                        "n_turns": len(turns),
                        "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                        "loss_chars": len(loss),
                        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                        "formatted_chars": len(formatted),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, _DIGESTS)


_DIGESTS = pa.schema([("conversation", pa.binary()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(packs: DataFrame, members: DataFrame) -> DataFrame:
    """Per conversation, from the packs alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.  Turns that a pack has only by digest come from the pack that
    emits them."""
    lacking = packs.select("pack", F.explode(F.filter("segments", lambda x: x["begin"] < 0)).alias("x")).select("pack", "x.node", "x.digest")
    lacking = written(lacking, "lacking")
    sent = packs.sparkSession.sparkContext.broadcast(bloom.build(lacking.select("digest").distinct().mapInArrow(_keys, "key long"), "key"))
    homes = packs.select("tokens", "segments").mapInArrow(_nodes(sent), "digest binary, shown string")
    found = lacking.join(homes, "digest").groupBy("pack").agg(F.collect_list(F.struct("node", "shown")).alias("elsewhere"))
    read = packs.join(found, "pack", "left").mapInArrow(_digests, "conversation binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(read, "conversation").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
