"""Alignment of two tokenizers' cuts of the same texts, by lockstep merging.

Both tokenizers cut a space and the text into tokens of bytes.  Texts are laid out as lanes; one
NumPy state vector holds, for every lane at once, the token of A and the token of B that are open.
A step links the two, marks a cut where both end, and moves on the one that ends first (both
at a cut); lanes that are through leave the vector.

A text of more than ``LANE`` bytes is several lanes: before a single space between two other
characters both tokenizers cut in any case.  A's pattern takes a space only at the beginning of a
token; B's vocabulary is looked through for a piece that goes on over a space, and if it has
one, texts stay whole.

How many documents hold a pair of ids linked is counted in blocks of documents first.  A block asks
for the counts of its own distinct pairs only, so what is shuffled is blocks x distinct pairs, not
documents x links, and no task holds more than the pairs of one block.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.bytewords import slices, utf8
from heddle.llm.shared import small_batches, written

TOKENIZERS = "/opt/tokenizers"
NAME_A, NAME_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
LANE, SLICE, BLOCK = 512, 1 << 20, 1 << 24


@dataclass
class Side:
    """A tokenizer: ``encode`` takes strings and gives all their ids on end and how many each has; ``data`` from
    ``start[id]`` on has the ``size[id]`` bytes of a token; ``size`` is 0 where an id has none."""

    encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    cuts_at_spaces: bool

    @staticmethod
    def of(encode, tokens: list[bytes], cuts_at_spaces: bool) -> Side:
        size = np.array([len(t) for t in tokens], np.int64)
        return Side(encode, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size, cuts_at_spaces)


def _lists_of(encode):
    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = encode(texts)
        number = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(number.sum())), number

    return run


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself where it is one in
    Latin-1, else the next of those from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def byte_bpe(source: bytes) -> Side:
    """A byte-level BPE of the tokenizers library.  Where ids follow the order of merges they are
    ranks as well, and a faster library gives the same ids."""
    import tokenizers

    told = json.loads(source)
    vocabulary, letters = told["model"]["vocab"], _byte_letters()
    special = {t["content"] for t in told.get("added_tokens", [])}
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for word, i in vocabulary.items():
        if word not in special:
            tokens[i] = bytes(letters[c] for c in word)
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
    split = told["pre_tokenizer"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer") and not told["model"].get("ignore_merges")
    if plain and merged == sorted(merged):
        import tiktoken

        # Fixed value: how byte-level vocabularies of this kind cut texts before merging.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        ranks = {t: i for i, t in enumerate(tokens) if t}
        fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return Side.of(_lists_of(lambda texts: [fast.encode_ordinary(t) for t in texts]), tokens, True)
    slow = tokenizers.Tokenizer.from_str(source.decode())
    slow.encode_special_tokens = True
    return Side.of(_lists_of(lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]), tokens, bool(plain))


@functools.cache
def piece_bpe(source: bytes) -> Side:
    """A sentencepiece model; it adds the space before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=source)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = []
    for i, piece in enumerate(pieces):
        if model.is_byte(i):
            tokens.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            tokens.append(b"")
        else:
            tokens.append(piece.replace("▁", " ").encode())
    goes_on = any("▁" in p.lstrip("▁") for p in pieces)
    return Side.of(_lists_of(lambda texts: model.encode(texts, num_threads=1)), tokens, not goes_on)


def lanes(spaced: np.ndarray, at: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes begin in ``spaced`` and which text each belongs to; texts begin at ``at``."""
    begin = at[:-1]
    if cut and len(spaced) > 2:
        solid = spaced > 32
        place = np.flatnonzero((spaced[1:-1] == 32) & solid[:-2] & solid[2:]) + 1
        text = np.searchsorted(at, place, "right") - 1
        nth = (place - at[text]) // LANE
        # the first such space in each stretch of LANE bytes; the first stretch begins the text
        own = (nth > 0) & (np.append(True, (nth[1:] != nth[:-1]) | (text[1:] != text[:-1])) if len(place) else True)
        # a space that begins the next text is that text's own
        own &= place > at[text]
        own &= place + 1 < at[text + 1]
        begin = np.sort(np.concatenate([begin, place[own]]))
    return begin, np.searchsorted(at, begin, "right") - 1


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``size[0]`` numbers, then on from start[1]."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _wrong(side: Side, ids: np.ndarray, number: np.ndarray, spaced: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which lanes have tokens whose bytes are not those of the lane."""
    long = np.concatenate([[0], np.cumsum(side.size[ids])])
    first = np.concatenate([[0], np.cumsum(number)])
    wrong = long[first[1:]] - long[first[:-1]] != size
    kept = np.repeat(~wrong, number)
    good = ids[kept]
    lane = np.repeat(np.flatnonzero(~wrong), size[~wrong])
    differ = side.data[_spread(side.start[good], side.size[good])] != spaced[_spread(begin[~wrong], size[~wrong])]
    wrong[lane[differ]] = True
    return wrong


def lockstep(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge all lanes at once.  ``ends``: where each token ends, on one scale for both sides;
    ``first[k]:first[k + 1]`` are the tokens of lane k.  Returns the links in order (token of A,
    token of B) and whether there is a cut behind each."""
    a, b, stop = first_a[:-1], first_b[:-1], first_a[1:]
    slot = a + b
    link_a = np.full(int(first_a[-1] + first_b[-1]), -1, np.int64)
    link_b, cut = np.zeros(len(link_a), np.int64), np.zeros(len(link_a), bool)
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        link_a[slot], link_b[slot], cut[slot] = a, b, end_a == end_b
        a, b, slot = a + (end_a <= end_b), b + (end_b <= end_a), slot + 1
        going = a < stop
        if not going.all():
            a, b, slot, stop = a[going], b[going], slot[going], stop[going]
    real = link_a >= 0
    return link_a[real], link_b[real], cut[real]


@functools.cache
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids below ``most`` in decimal, in rows of eight bytes or more from the left, and their widths."""
    wide = max(8, len(str(most)) + 1)
    rows = np.zeros((most, wide), np.uint8)
    width = np.ones(most, np.int64)
    for k in range(1, wide):
        width[10**k :] += 1
    rest = np.arange(most)
    for k in range(int(width.max())):
        left = np.flatnonzero(width > k)
        rows[left, width[left] - 1 - k] = 48 + rest[left] % 10
        rest //= 10
    return rows, width


def _written_out(ids: np.ndarray, behind: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids on end, each with a byte behind it, and where each begins."""
    rows, width = _digits(most)
    long = width[ids]
    out = rows.view(np.uint64)[ids].view(np.uint8).reshape(-1, rows.shape[1]) if rows.shape[1] == 8 else rows[ids]
    out[np.arange(len(ids)), long] = behind
    long += 1
    return out[np.arange(out.shape[1]) < long[:, None]], np.cumsum(long) - long


def _groups(ids_a, group_a, doc_a, ids_b, group_b, docs: int, most: int) -> list[str]:
    """The digest of each text's groups; '' without tokens."""
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    before_b, upto_a = np.cumsum(per_b) - per_b, np.cumsum(per_a)
    total = len(ids_a) + len(ids_b)
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + upto_a[group_b]
    ids, behind = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    behind[upto_a + before_b - 1] = ord("|")
    behind[upto_a + np.cumsum(per_b) - 1] = ord(";")
    text, start = _written_out(ids, behind, most)
    start = np.append(start, len(text))
    of = np.bincount(doc_a, minlength=docs)
    first_a = np.concatenate([[0], np.cumsum(of)])
    whole, out = text.tobytes(), []
    for d in range(docs):
        if not of[d]:
            out.append("")
            continue
        begin = place_a[first_a[d]]
        end = place_a[first_a[d + 1]] if first_a[d + 1] < len(ids_a) else total
        out.append(hashlib.sha256(whole[start[begin] : start[end] - 1]).hexdigest())
    return out


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def align(texts: pa.Array, a: Side, b: Side) -> dict[str, object]:
    """Tokens, links, groups and distinct linked pairs of each text."""
    docs = len(texts)
    raw, at = utf8(texts)
    full = np.diff(at) > 0
    which = np.flatnonzero(full)
    spaced = np.insert(raw, at[:-1][full], 32)
    at = np.concatenate([[0], np.cumsum(np.diff(at)[full] + 1)])
    begin, text = lanes(spaced, at, a.cuts_at_spaces and b.cuts_at_spaces)
    size = np.diff(np.append(begin, len(spaced)))
    held = spaced.tobytes()
    body = [held[p + 1 : p + n].decode() for p, n in zip(begin.tolist(), size.tolist(), strict=True)]
    ids_a, number_a = a.encode([" " + t for t in body])
    ids_b, number_b = b.encode(body)
    bad = _wrong(a, ids_a, number_a, spaced, begin, size) | _wrong(b, ids_b, number_b, spaced, begin, size)
    if bad.any():
        kept = ~np.isin(text, text[bad])
        ids_a, ids_b = ids_a[np.repeat(kept, number_a)], ids_b[np.repeat(kept, number_b)]
        text, number_a, number_b = text[kept], number_a[kept], number_b[kept]
    doc = which[text]
    ends_a, ends_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
    first = lambda n: np.concatenate([[0], np.cumsum(n)])
    link_a, link_b, cut = lockstep(ends_a, first(number_a), ends_b, first(number_b))
    doc_a, doc_b = np.repeat(doc, number_a), np.repeat(doc, number_b)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[link_a[cut]] = last_b[link_b[cut]] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    span = len(a.size) * len(b.size)
    key = np.sort(doc_a[link_a] * span + ids_a[link_a] * len(b.size) + ids_b[link_b])
    one = _runs(key)
    count = lambda x: np.bincount(x, minlength=docs)
    return {
        "n_a": count(doc_a),
        "n_b": count(doc_b),
        "n_groups": count(doc_a[link_a[cut]]),
        "n_links": count(doc_a[link_a]),
        "groups_sha256": _groups(ids_a, group_a, doc_a, ids_b, group_b, docs, max(len(a.size), len(b.size))),
        "pairs": key[one] % span,
        "times": np.diff(np.append(one, len(key))),
        "first": first(count(key[one] // span)),
    }


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, pairs array<long>, times array<int>, is_block boolean"


def _aligned(sent, kind: pa.DataType, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (f(source) for f, source in zip((byte_bpe, piece_bpe), sent.value, strict=True))
        task = TaskContext.get().partitionId() << 32
        block, seen, pairs, docs = task, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(ids, got, times, lists, is_block):
            n = len(ids)
            numbers = [pa.array(got[c], pa.int64()) if got else pa.nulls(n, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            digest = pa.array(got["groups_sha256"] if got else [None] * n, pa.string())
            fields = [ids, *numbers, digest, pa.array(np.full(n, block)), lists, times, pa.array([is_block] * n)]
            return pa.RecordBatch.from_arrays(fields, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "pairs", "times", "is_block"])

        def block_row():
            ends = np.array([0, len(pairs)])
            return rows(pa.nulls(1, kind), None, _lists(docs, ends, pa.int32()), _lists(pairs, ends, pa.int64()), True)

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                got = align(part.column("text"), a, b)
                yield rows(part.column("doc_id"), got, _lists(got["times"], got["first"], pa.int32()), _lists(got["pairs"], got["first"], pa.int64()), False)
                both, number = np.concatenate([pairs, got["pairs"]]), np.concatenate([docs, np.ones(len(got["pairs"]), np.int64)])
                order = np.argsort(both, kind="stable")
                one = _runs(both[order])
                pairs, docs = both[order][one], np.add.reduceat(number[order], one) if len(one) else docs
                seen += part.column("text").nbytes
                if seen >= block_bytes:
                    yield block_row()
                    block, seen, pairs, docs = block + 1, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if seen:
            yield block_row()

    return run


def _scored(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Sums over the links of a block's documents, with the counts of the block's pairs."""
    docs, known = docs.combine_chunks(), known.combine_chunks()
    pair = np.asarray(known["pair"], np.int64)
    order = np.argsort(pair)
    pair, held, best = pair[order], np.asarray(known["docs"], np.int64)[order], np.asarray(known["best"].cast(pa.int8()), np.int64)[order]
    lists = docs["pairs"].combine_chunks()
    size = np.asarray(lists.value_lengths(), np.int64)
    at = np.searchsorted(pair, np.asarray(lists.flatten(), np.int64))
    times = np.asarray(docs["times"].combine_chunks().flatten(), np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(total(times * best[at]))).append_column("count_sum", pa.array(total(times * held[at])))
    return out.append_column("groups_sha256", docs["groups_sha256"].cast(pa.string()))


def sources(folder: str = TOKENIZERS, name_a: str = NAME_A, name_b: str = NAME_B) -> tuple[bytes, bytes]:
    """The vocabulary files, a few megabytes, as read by the driver."""
    return Path(folder, name_a).read_bytes(), Path(folder, name_b).read_bytes()


def aligned(docs: DataFrame, vocabularies: tuple[bytes, bytes] | None = None, *, block_bytes: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the tokens of both sides, the distinct linked pairs of ids
    (A's id times the size of B's vocabulary plus B's id) and how many links each has; and a row
    for each block with its pairs and how many of its documents hold them.  Written."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabularies or sources())
    small_batches(docs.sparkSession)
    field = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    read = docs.select("doc_id", "text")
    return written(read.mapInArrow(_aligned(sent, to_arrow_type(docs.schema["doc_id"].dataType), block_bytes), f"doc_id {field}, {_ALIGNED}"), "aligned")


def alignment(docs: DataFrame, vocabularies: tuple[bytes, bytes] | None = None, *, block_bytes: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is
    held by as many documents as any pair of its A id), count_sum (documents holding the pair, over
    all links), groups_sha256.

    Texts that are null or empty, or that the two vocabularies do not give back byte for byte,
    have zeros and '' throughout.  Every row counts as a document, repeated ones too; an
    empty table gives none."""
    vocabularies = vocabularies or sources()
    wide = len(piece_bpe(vocabularies[1]).size)
    table = aligned(docs, vocabularies, block_bytes=block_bytes)
    wanted = table.filter("is_block").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("here"))
    counts = written(wanted.groupBy("pair").agg(F.sum("here").alias("docs")), "pairs")
    side = F.expr(f"pair div {wide}")
    top = counts.groupBy(side.alias("a")).agg(F.max("docs").alias("most"))
    known = counts.withColumn("a", side).join(top, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    told = wanted.select(F.col("block").alias("of"), "pair").join(known, "pair")
    rows = table.filter(~F.col("is_block")).drop("is_block")
    field = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(
        _scored, f"doc_id {field}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
