"""Secret scans with corpus-wide ownership frequency.

Patterns and the shape of tokens give candidates. For the hash of each candidate's value
the corpus tells how many repositories and owners hold it: a value of many owners is a
copied example, a value of one owner looks live. Opaque tokens without a pattern count
as secrets unless they are copied examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.batches import Texts, slices
from stratamem.llm.joins import left_join_unique
from stratamem.operators.bounded import MAX_BROADCAST_ROWS
from stratamem.session import materialize

# The base kinds with their patterns and least lengths.
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KINDS = ("assign", "access", "hex", "opaque")

OPAQUE_MIN = 20
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % OPAQUE_MIN)
# A value held by this many owners is an example that people copy.
WIDE_OWNERS = 3

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, sorted by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= HEX_MIN]
    return sorted(found)


def opaque_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of letters and digits that touch no base span; ``taken`` is sorted by start."""
    found, n, reach = [], 0, 0
    for m in OPAQUE.finditer(text):
        # The largest end of the base spans that start before this token ends.
        while n < len(taken) and taken[n][0] < m.end():
            reach = max(reach, taken[n][2])
            n += 1
        if reach <= m.start() and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return found


def _suspects(texts: Texts) -> np.ndarray:
    """The texts in which a pattern can match."""
    where = []
    for kind, least in ((_HEX, HEX_MIN), (_TOKEN, OPAQUE_MIN)):
        start, end, _ = texts.spans(kind)
        where.append(start[end - start >= least])
    raw = texts.data.tobytes()
    low = raw.lower()
    for data, word in [(low, w) for w in _WORDS] + [(raw, b"AKIA")]:
        at, hits = data.find(word), []
        while at >= 0:
            hits.append(at)
            at = data.find(word, at + len(word))
        where.append(np.array(hits, np.int64))
    return np.unique(np.searchsorted(texts.at, np.concatenate(where), side="right") - 1)


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())]))
_SCANNED = pa.schema([("doc_id", pa.int64()), ("repository", pa.string()), ("owner", pa.string()),
                      ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                      ("base_sha256", pa.string()), ("found", _FOUND)])
_SCANNED_DDL = ("doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, "
                "base_sha256 string, found array<struct<start: long, kind: int, end: long, value: long>>")


def _join(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def _value(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), [])
    for whole in batches:
        for batch in slices(whole):
            rows = [nothing] * batch.num_rows
            for i in _suspects(Texts(batch.column("text"))).tolist():
                text = batch.column("text")[i].as_py()
                base = base_spans(text)
                spans = base + opaque_spans(text, base)
                kinds = [s[1] for s in base]
                rows[i] = (*(kinds.count(k) for k in range(3)), hashlib.sha256(_join(base).encode()).hexdigest(),
                           [{"start": a, "kind": k, "end": b, "value": _value(v)} for a, k, b, v in spans])
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_SCANNED)[3:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "repository", "owner")), *made], schema=_SCANNED)


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value of (value, repository, owner): places, distinct repositories and distinct owners.

    Counts run from the finest key up, each summed where the rows lie before it moves, so
    a value that a third of the corpus holds reaches no task row by row.
    """
    per_repository = candidates.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("places"))
    per_owner = per_repository.groupBy("value", "owner").agg(
        F.sum("places").alias("places"), F.count(F.lit(1)).alias("repositories"))
    return per_owner.groupBy("value").agg(
        F.sum("places").alias("places"), F.sum("repositories").alias("repositories"),
        F.count(F.lit(1)).alias("owners"))


def find_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source",
                 wide_owners: int = WIDE_OWNERS, broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Find secrets in every whole text of ``docs`` (doc_id, text, and the two columns named).

    Null texts are empty; a null repository or owner counts as one of its own. A value with
    ``wide_owners`` or more owners is a copied example, one of a single owner looks live. Base
    spans are all kept whatever the corpus says; opaque tokens are kept, in spans and in
    secrets, unless as many owners hold them as a copied example has.
    Every row gives one row, repeated ones too, and an empty table an empty result. Returns
    doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_shared, and secrets
    (start, end, kind, owners, repositories, verdict).
    """
    scanned = docs.select("doc_id", "text", F.col(repository).cast("string").alias("repository"),
                          F.col(owner).cast("string").alias("owner")).mapInArrow(_scan, _SCANNED_DDL)
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    candidates = scanned.filter(F.size("found") > 0).select(
        "row", F.coalesce("repository", F.lit("\0")).alias("repository"),
        F.coalesce("owner", F.lit("\0")).alias("owner"), F.inline("found"))
    owned = materialize(ownership(candidates), "ownership")
    rows = candidates.select("row", "start", "kind", "end", "value")
    judged = left_join_unique(rows, owned, "value", "places", candidates.count(), broadcast_rows)
    verdict = F.when(F.col("owners") >= wide_owners, "copied").when(F.col("owners") == 1, "live").otherwise("shared")
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    judged = judged.withColumn("verdict", verdict).filter(
        (F.col("kind") < 3) | (F.col("verdict") != "copied"))
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.col("kind").alias("rank"), "end", name.alias("kind"), "owners", "repositories", "verdict"))
    ).alias("secrets"))
    out = scanned.join(per_row, "row", "left")
    text = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda v: F.coalesce(F.size(F.filter("secrets", lambda s: s["verdict"] == v)), F.lit(0)).cast("long")
    none = F.col("secrets").isNull()
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.when(none, "").otherwise(text).alias("spans"),
        F.when(none, 0).otherwise(count("live")).cast("long").alias("n_live"),
        F.when(none, 0).otherwise(count("copied")).cast("long").alias("n_copied"),
        F.when(none, 0).otherwise(count("shared")).cast("long").alias("n_shared"), "secrets")
