"""Quartile bucket digests of whole texts, and their comparison.

Three triplets of each window of five bytes are hashed into 128 buckets. The digest holds, for each bucket, the quartile
its count falls in (2 bits), and in front the length on a logarithmic scale (8 bits) and the ratios of the quartiles to
the upper one (4 bits each): 68 hex digits. Similar texts differ in few quartiles.

Defined cases. NULL text: as the empty text. Texts under three bytes: all counts are zero. Equal texts have equal digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm.words import slices, text_bytes

BUCKETS = 128
#: places of the second and third byte of each triplet, and its salt
TRIPLETS = ((1, 2, 2), (1, 3, 3), (2, 4, 5))
#: A quartile that is off by 0, 1, 2 or 3 counts as
STEP_COST = np.array([0, 1, 2, 6], np.int64)
LENGTH_COST, LENGTH_MOST, RATIO_COST = 2, 64, 2
WORST = 3 * BUCKETS + LENGTH_MOST + 2 * 15 * RATIO_COST


def digests(data: np.ndarray, ends: np.ndarray) -> list[str]:
    """Digest of each document in a slice of text."""
    n = len(ends) - 1
    length = np.diff(ends)
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, length)
    left = np.repeat(ends[1:], length) - np.arange(len(data))  # bytes to the end of the document, this one included
    wide = data.astype(np.uint32)
    counts = np.zeros(n * BUCKETS, np.int64)
    for j, k, salt in TRIPLETS:
        size = max(0, len(data) - k)
        x = wide[:size] * np.uint32(0x9E3779B1)
        x += wide[j : j + size] * np.uint32(0x85EBCA77)
        x += wide[k : k + size] * np.uint32(0xC2B2AE3D)
        x += np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x >>= np.uint32(25)
        ok = left[:size] > k
        counts += np.bincount((row[:size] + x)[ok], minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, i * BUCKETS // 4 - 1] for i in (1, 2, 3))
    codes = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    body = (codes[:, 0::4] << 6) | (codes[:, 1::4] << 4) | (codes[:, 2::4] << 2) | codes[:, 3::4]
    size = np.minimum(255, np.rint(8 * np.log2(1 + length))).astype(np.uint8)
    top = np.maximum(q3, 1)
    ratios = ((15 * q1 // top) << 4 | (15 * q2 // top)).astype(np.uint8)
    packed = np.concatenate([size[:, None], ratios[:, None], body.astype(np.uint8)], axis=1)
    return [p.tobytes().hex() for p in packed]


def _unpack(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), -1).astype(np.int64)
    body = raw[:, 2:]
    return raw[:, 0], raw[:, 1] >> 4, raw[:, 1] & 15, np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], 2)


def likeness(one: list[str], other: list[str]) -> np.ndarray:
    """1 for equal digests, down to 0: one minus the difference score over half of the worst body and all of the head."""
    if not one:
        return np.zeros(0)
    (size_a, r_a, s_a, body_a), (size_b, r_b, s_b, body_b) = _unpack(one), _unpack(other)
    score = STEP_COST[np.abs(body_a - body_b)].sum(axis=(1, 2))
    score += np.minimum(LENGTH_MOST, LENGTH_COST * np.abs(size_a - size_b))
    score += RATIO_COST * (np.abs(r_a - r_b) + np.abs(s_a - s_b))
    return np.maximum(0.0, 1.0 - score / WORST)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) -> doc_id, ``n_chars`` (code points), ``fingerprint``; nothing is shuffled."""

    def run(batches):
        for part in slices(batches, text_col):
            data, ends = text_bytes(part.column(text_col))
            chars = _code_points(data, ends)
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), pa.array(chars), pa.array(digests(data, ends), pa.string())],
                names=[id_col, "n_chars", "fingerprint"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, fingerprint string")


def _code_points(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]).astype(np.int64)


def with_next_document(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Rows (bucket, tail, place, doc_id, text) such that, sorted within its bucket, each is followed by the next document.

    Buckets are ranges of doc_id, cut at approximate percentiles; the first row of a bucket goes to the bucket before it
    as well, with ``tail`` set, and the very first to the last bucket. So each whole text moves once, and no order over
    the whole table is formed in one task. The driver sees two ids per bucket; their number is a parameter.
    """
    buckets = buckets or max(1, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))  # a NULL id comes first
    rows = docs.select(place.alias("place"), "doc_id", "text")
    cut = rows.agg(F.percentile_approx("place", [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets).alias("c"))
    cuts = np.unique(np.array(cut.first()["c"] or [], np.int64)) if buckets > 1 else np.zeros(0, np.int64)

    def number(places) -> np.ndarray:
        return np.searchsorted(cuts, np.asarray(places, np.int64), side="right").astype(np.int32)

    def lowest(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            b = number(at)
            found, back = np.unique(b, return_inverse=True)
            low = np.full(len(found), np.iinfo(np.int64).max)
            np.minimum.at(low, back, at)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(low)], names=["bucket", "place"])

    firsts = rows.select("place").mapInArrow(lowest, "bucket int, place long").groupBy("bucket").agg(F.min("place").alias("p"))
    firsts = sorted((r["bucket"], r["p"]) for r in firsts.collect())
    before = {p: firsts[i - 1][0] for i, (_, p) in enumerate(firsts)}
    leads = np.array(sorted(before), np.int64)
    owners = np.array([before[p] for p in leads], np.int32)

    def deal(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            b = number(at)
            yield _tagged(batch, b, 0)
            first = np.flatnonzero(np.isin(at, leads))
            if len(first):
                yield _tagged(batch.take(pa.array(first)), owners[np.searchsorted(leads, at[first])], 1)

    dealt = rows.mapInArrow(deal, "bucket int, tail int, place long, doc_id long, text string")
    return dealt, buckets


def _tagged(batch, bucket, tail):
    flags = pa.array(np.full(len(bucket), tail, np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), flags, *batch.columns], names=["bucket", "tail", *batch.schema.names]
    )


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's digest, that of an edited text, and how alike they are (columns: ``EDITED``).

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document by doc_id; the last document is followed by the first. Rows of equal doc_id are ordered by text.
    """
    dealt, buckets = with_next_document(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    ordered = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "tail", "place", "text")

    def run(batches):
        held, before, size = [], None, 0  # (doc_id, text, edited, next text) until a few megabytes are together
        for part in slices(batches):
            for bucket, tail, doc, text in zip(
                *(part.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True
            ):
                if before is not None and before[0] == bucket:
                    own = before[2]
                    half = len(own) // 2
                    held.append((before[1], own, own[: len(own) - half] + text[:half], text))
                    size += len(own) + len(text)
                before = None if tail else (bucket, doc, text)
            if size >= 4 << 20:
                yield _compare(held)
                held, size = [], 0
        if held:
            yield _compare(held)

    return ordered.mapInArrow(run, EDITED)


def _compare(held: list[tuple]) -> pa.RecordBatch:
    docs, texts, edited, following = (list(x) for x in zip(*held, strict=True))
    own = digests(*text_bytes(pa.array(texts, pa.large_string())))
    changed = digests(*text_bytes(pa.array(edited, pa.large_string())))
    # the next document is the next row, but for the last of a bucket
    after = own[1:] + digests(*text_bytes(pa.array(following[-1:], pa.large_string())))
    jumps = [i for i in range(len(texts) - 1) if following[i] is not texts[i + 1]]
    for i, d in zip(jumps, digests(*text_bytes(pa.array([following[i] for i in jumps], pa.large_string()))), strict=True):
        after[i] = d
    names = [x.split()[0] for x in EDITED.split(", ")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(docs, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(own),
            pa.array(changed),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, after)),
        ],
        names=names,
    )
