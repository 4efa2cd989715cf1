"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of a text is a blob, named by its SHA-256.  The ledger remembers which
(blob, rule version) pairs were scanned and what was found; a run scans only unseen
pairs, one copy of each blob, and joins findings back to every path that holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.bytewords import LOWER, slices, utf8
from heddle.llm.shared import written

RULE_VERSION = 1

# The patterns of the rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
# Rule names in the order in which equal starts are listed, base rules first.
KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE = KINDS[:3]

#: Any text with a match of a rule has one of these, lower-cased.
_HINT = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']? *[:=]|akia[a-z0-9]|-----begin |eyj[a-z0-9_-]+\.eyj""")


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind, end), in code points, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    found += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in JWT.finditer(text)]
    return sorted(found)


_IS_HEX = np.zeros(256, bool)
_IS_HEX[0x30:0x3A] = _IS_HEX[0x61:0x67] = True


def _suspects(texts: pa.Array) -> np.ndarray:
    """Which texts may have a match: a hint of a rule, or 32 hexadecimal bytes in a row."""
    raw, at = utf8(texts)
    out = np.zeros(len(at) - 1, bool)
    if not len(raw):
        return out
    inside = np.concatenate(([False], _IS_HEX[raw], [False])).astype(np.int8)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a run may cross from one text into the next ones; then all of them are scanned
    for first, last in zip(starts[ends - starts >= 32], ends[ends - starts >= 32] - 1, strict=True):
        a, b = np.searchsorted(at, (first, last), "right") - 1
        out[a : b + 1] = True
    for m in _HINT.finditer(LOWER[raw].tobytes()):
        a, b = np.searchsorted(at, (m.start(), m.end() - 1), "right") - 1
        out[a : b + 1] = True
    # a hint cut by the edge of a text is none, so nothing is lost by scanning too much
    return out


FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text")
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for i in np.flatnonzero(_suspects(texts)):
                found[i] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan_text(texts[int(i)].as_py() or "")]
            yield pa.RecordBatch.from_arrays([part.column("blob"), pa.array(found, pa.list_(FOUND))], ["blob", "found"])


LEDGER = "blob binary, rule_version int, found array<struct<kind:string,start:bigint,end:bigint>>"


def scan_unseen(paths: DataFrame, path: str, text: str, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan the versions in ``paths`` (``path`` names a version, ``text`` is its content).

    Returns ``(located, added)``: ``added`` are the ledger rows of all pairs scanned now, also
    of blobs without findings, so that the next run does not scan those again;
    ``located`` has ``path``, ``blob`` and ``found`` for every row of ``paths``.  A null text is
    the empty blob; repeated rows are all located; an empty table gives empty results.

    The blobs to scan travel once; copies of a blob are only its hash."""
    named = paths.select(F.col(path).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("blob"))
    # one path for each blob: the one to read it from
    unseen = named.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        unseen = unseen.join(seen, "blob", "left_anti")
    unseen = unseen.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"))
    whole = paths.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # blob as well: a path may have several versions
    source = whole.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    read = source.join(unseen, source["path"].eqNullSafe(unseen["_path"]) & (source["blob"] == unseen["_blob"]), "left_semi")
    scanned = read.select("blob", "text").mapInArrow(_scan, "blob binary, found array<struct<kind:string,start:bigint,end:bigint>>")
    # repeated rows of one path are scanned once each but enter the ledger once
    once = scanned.dropDuplicates(["blob"])
    added = written(once.select("blob", F.lit(rule_version).alias("rule_version"), "found"), "ledger")
    known = added if ledger is None else added.unionByName(ledger.filter(F.col("rule_version") == rule_version))
    located = named.join(known.filter(F.size("found") > 0).select("blob", "found"), "blob", "left")
    return located.withColumn("found", F.coalesce("found", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))), added


def scan(paths: DataFrame, path: str, text: str, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """``scan_unseen``, with those rows of ``added`` only that have findings.  They are no whole
    ledger: a run that is given no more than them scans clean blobs again."""
    located, added = scan_unseen(paths, path, text, ledger, rule_version)
    return located, added.filter(F.size("found") > 0)


def document_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null or empty text has no spans and the digest of no bytes."""
    located, _ = scan_unseen(docs, "doc_id", "text", ledger)
    of = lambda k: F.filter("found", lambda f: f["kind"] == k)
    listed = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return located.select(
        F.col("path").alias("doc_id"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.filter("found", lambda f: f["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )
