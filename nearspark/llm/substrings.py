"""Removal of repeated passages by repeated-phrase automata.

A window is ``n`` consecutive words. A word goes if a window over it also starts in a document with a smaller doc_id.

1. Every window selects an anchor: the 5-word place with the lowest hash inside it (about one word in five is one). Equal
   windows have equal anchors, so a window can recur only where its anchor occurs in two documents. The anchors are
   counted over the whole corpus.
2. The windows at such anchors are confirmed: per window, the smallest and the largest doc_id that have it.
3. The confirmed windows are phrases of shards, by anchor. Each shard's phrases, as sequences of 32-bit word numbers,
   are compiled into an Aho-Corasick automaton, and the stretches of all documents around the shard's anchors run
   through it. A hit counts if the 64-bit hash of the window is right too.

A shard has about ``SHARD`` stretches, so an automaton has a bounded size (and few children at its root, which the library
searches in line); an anchor with more than ``HOT`` is spread over several shards, by document, with the same phrases. A bitmap of fixed size keeps most stretches without a
recurring anchor, and most texts without a hit, from being shuffled.

Defined cases. NULL text: no words. NULL doc_id: greater than every id. Rows with equal doc_id are not before one another;
each is judged by its own text. Texts under ``n`` words are kept. Extra columns are carried along; internal columns begin
with two underscores.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm.graph import bitmap, maybe_in
from nearspark.llm.words import U, Words, give_back, mix, rolling, sequence_hashes, slices, starts_within, text_bytes
from nearspark.session import cut_lineage

ANCHOR = 5
SHARD, HOT = 1_000, 20_000
FILTER_BITS = 26
LAST = 2**63 - 1


class Passages:
    """Windows of a slice of documents: where they start (``at``, in words), their documents and their anchors.

    ``first`` marks the windows that begin a stretch: neighbours in one document with the same anchor.
    """

    def __init__(self, column: pa.Array, n: int):
        self.words = Words(*text_bytes(column))
        self.hashes = self.words.hashes()
        self.at = starts_within(self.words.row, n)
        self.anchors = rolling(np.minimum, sequence_hashes(self.hashes, ANCHOR), n - ANCHOR + 1)[self.at]
        self.owner = self.words.owner()[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.first = np.ones(len(self.at), bool)
        self.first[1:] = (self.anchors[1:] != self.anchors[:-1]) | (self.owner[1:] != self.owner[:-1])


def text_ids(words: Words, hashes: np.ndarray) -> np.ndarray:
    """64-bit hash of the words of each document."""
    place = np.arange(len(hashes), dtype=U) - np.repeat(words.row[:-1], words.counts).astype(U)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes ^ mix(place)))])
    return mix(sums[words.row[1:]] - sums[words.row[:-1]] + words.counts.astype(U))


def _places(part) -> np.ndarray:
    return part.column("__place").to_numpy()


def recurring_windows(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Anchors that two documents have (anchor, low, high, docs), and the windows at them that recur (window, anchor, low)."""
    spark = rows.sparkSession

    def anchors(batches):
        for part in slices(batches):
            p = Passages(part.column("text"), n)
            ids = _places(part)[p.owner[p.first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.anchors[p.first].astype(np.int64)), pa.array(ids)], names=["anchor", "doc"]
            )

    seen = rows.mapInArrow(anchors, "anchor long, doc long").groupBy("anchor")
    seen = seen.agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("docs"))
    live = cut_lineage(seen.where("low < high"))
    table = spark.sparkContext.broadcast(bitmap(live, "anchor", FILTER_BITS))

    def windows(batches):
        for part in slices(batches):
            p = Passages(part.column("text"), n)
            may = maybe_in(table.value, p.anchors)
            window = sequence_hashes(p.hashes, n)[p.at[may]]
            ids = _places(part)[p.owner[may]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (window, p.anchors[may], ids)], names=["window", "anchor", "doc"]
            )

    found = rows.mapInArrow(windows, "window long, anchor long, doc long").groupBy("window", "anchor")
    found = found.agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    return live, cut_lineage(found.select("window", "anchor", "low"))


def locate(rows: DataFrame, live: DataFrame, recurring: DataFrame, n: int) -> DataFrame:
    """(doc, text_id, hits): the word places, as bytes, where a window with a smaller doc_id elsewhere starts."""
    spark = rows.sparkSession
    table = spark.sparkContext.broadcast(bitmap(recurring, "anchor", FILTER_BITS))
    total = live.agg(F.sum("docs")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    # at most total / HOT anchors
    hot = {r["anchor"]: -(-r["docs"] // HOT) for r in live.where(F.col("docs") > HOT).select("anchor", "docs").collect()}
    hot_keys = np.array(sorted(hot), np.int64)
    hot_salts = np.array([hot[k] for k in sorted(hot)], np.int64)

    def salts_of(anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), np.int64)
        if len(hot_keys):
            at = np.minimum(np.searchsorted(hot_keys, anchors), len(hot_keys) - 1)
            out = np.where(hot_keys[at] == anchors, hot_salts[at], 1)
        return out

    def shard_of(anchors: np.ndarray) -> np.ndarray:
        return (mix(anchors.astype(U) + U(1)) % U(shards)).astype(np.int64)

    def stretches(batches):
        names, sent = ["shard", "salt", "doc", "text_id", "at", "ids", "windows"], set()
        for part in slices(batches):
            p = Passages(part.column("text"), n)
            begin = np.flatnonzero(p.first)
            stop = np.append(begin[1:], len(p.at))
            may = maybe_in(table.value, p.anchors[begin])
            docs, text_id = _places(part), text_ids(p.words, p.hashes).astype(np.int64)
            new = np.ones(part.num_rows, bool)  # hits are joined by (doc, text_id): equal rows are sent once a task
            for i, one in enumerate(zip(docs.tolist(), text_id.tolist(), strict=True)):
                new[i] = one not in sent
                sent.add(one)
            may &= new[p.owner[begin]]
            begin, stop = begin[may], stop[may]
            owner, anchor = p.owner[begin], p.anchors[begin].astype(np.int64)
            doc, text_id = docs[owner], text_id[owner]
            ids, window = (p.hashes & U(0xFFFFFFFF)).astype(np.uint32), sequence_hashes(p.hashes, n)
            first, last = p.at[begin], p.at[stop - 1]
            # by document and place: neither copies of a text nor one text full of the anchor share a salt
            at = first - p.words.row[owner]
            own = mix(mix(doc.astype(U)) ^ text_id.astype(U)) + at.astype(U)
            salt = (mix(own) % salts_of(anchor).astype(U)).astype(np.int64)
            columns = [
                pa.array(shard_of(anchor)), pa.array(salt), pa.array(doc), pa.array(text_id),
                pa.array(at),
                pa.array([ids[a : b + n].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
                pa.array([window[a : b + 1].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def phrases(batches):
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            salts = salts_of(anchor)
            row = np.repeat(np.arange(len(anchor)), salts)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(salts) - salts, salts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard_of(anchor)[row]), pa.array(salt), *(batch.column(c).take(pa.array(row)) for c in ("window", "low"))],
                names=["shard", "salt", "window", "low"],
            )

    def found_in(stretches, phrases):
        import ahocorasick

        hits = {"doc": [], "text_id": [], "hits": []}
        if stretches.num_rows and phrases.num_rows:
            window, low = phrases.column("window").to_numpy().astype(U), phrases.column("low").to_numpy()
            order = np.argsort(window)
            window, low = window[order], low[order]
            # all stretches in a row; own[i]: the hash of the window that starts at word i, if it lies in a stretch
            ids, windows = stretches.column("ids").to_pylist(), stretches.column("windows").to_pylist()
            every = np.frombuffer(b"".join(windows), U)
            counts = np.array([len(w) // 8 for w in windows])
            begin = np.concatenate([[0], np.cumsum(counts + n - 1)])[:-1]
            at = np.arange(len(every)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
            words = tuple(np.frombuffer(b"".join(ids), np.uint32).tolist())
            own, inside = np.zeros(len(words), U), np.zeros(len(words), bool)
            own[at], inside[at] = every, True

            place = np.minimum(np.searchsorted(window, every), len(window) - 1)
            known = np.flatnonzero(window[place] == every)
            _, once = np.unique(every[known], return_index=True)
            once = known[once]
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            alike: dict[tuple, list[int]] = {}  # phrases whose 32-bit numbers are those of another one
            for i, start in zip(place[once].tolist(), at[once].tolist(), strict=True):
                phrase = words[start : start + n]
                if (one := automaton.get(phrase, None)) is None:
                    automaton.add_word(phrase, i)
                else:
                    alike.setdefault(phrase, [one]).append(i)
            for phrase, all_ in alike.items():
                automaton.add_word(phrase, tuple(all_))
            if len(once):
                automaton.make_automaton()
                found = [(end, i) for end, i in automaton.iter(words)]
                if alike:
                    found = [(end, i) for end, all_ in found for i in (all_ if isinstance(all_, tuple) else (all_,))]
                end, which = np.array(found, np.int64).reshape(-1, 2).T
                start = end - n + 1
                true = inside[start] & (own[start] == window[which])
                start, which = start[true], which[true]
                row = np.searchsorted(begin, start, side="right") - 1
                doc = stretches.column("doc").to_numpy()
                earlier = low[which] < doc[row]
                start, row = start[earlier], row[earlier]
                word = start - begin[row] + stretches.column("at").to_numpy()[row]
                order = np.lexsort((word, row))
                row, word = row[order], word[order]
                rows, cut = np.unique(row, return_index=True)
                hits["doc"] = doc[rows]
                hits["text_id"] = stretches.column("text_id").to_numpy()[rows]
                hits["hits"] = [x.tobytes() for x in np.split(word, cut[1:])] if len(rows) else []
        return pa.table(
            [pa.array(hits["doc"], pa.int64()), pa.array(hits["text_id"], pa.int64()), pa.array(hits["hits"], pa.binary())],
            names=list(hits),
        )

    def search(key, stretches, phrases):
        hits = found_in(stretches, phrases)
        give_back()
        return hits

    kind = "shard long, salt long, doc long, text_id long, at long, ids binary, windows binary"
    left = rows.mapInArrow(stretches, kind).groupBy("shard", "salt")
    right = recurring.mapInArrow(phrases, "shard long, salt long, window long, low long").groupBy("shard", "salt")
    return left.cogroup(right).applyInArrow(search, "doc long, text_id long, hits binary")


def remove_repeats(docs: DataFrame, n: int = 13, digest: bool = False) -> DataFrame:
    """The documents without their repeated passages: the input's columns, ``text`` being the kept words joined by blanks
    where any was removed, and unchanged elsewhere; with ``__n_words`` and ``__n_removed``.

    With ``digest``: doc_id, n_words, n_removed and the SHA-256 of the kept words instead.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.select(place.alias("__place"), "text")
    live, recurring = recurring_windows(rows, n)
    found = locate(rows, live, recurring, n).groupBy("doc", "text_id").agg(F.collect_set("hits").alias("__hits"))
    found = cut_lineage(found.select(F.col("doc").alias("__doc"), F.col("text_id").alias("__text"), "__hits"))
    table = docs.sparkSession.sparkContext.broadcast(bitmap(found, "__doc", FILTER_BITS))

    keep = ["doc_id"] if digest else [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def prepare(batches):
        for part in slices(batches):
            text = part.column("text")
            words = Words(*text_bytes(text))
            may = maybe_in(table.value, _places(part))
            hit = np.flatnonzero(may)
            text_id = np.zeros(len(may), U)
            if len(hit):
                own = Words(*text_bytes(text.take(pa.array(hit))))
                text_id[hit] = text_ids(own, own.hashes())
            shas = [None] * len(may)
            if digest:  # only texts that may lose words travel
                shas = [None if m else _sha(t) for m, t in zip(may, text, strict=True)]
                text = pa.array([t.as_py() if m else None for m, t in zip(may, text, strict=True)], pa.string())
            columns = [pa.array(text_id.astype(np.int64)), pa.array(words.counts.astype(np.int64)), text, pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [part.column("__place"), *(part.column(c) for c in keep), *columns],
                names=["__place", *keep, "__text_id", "__n_words", "text", "__sha"],
            )

    def finish(batches):
        for part in slices(batches):
            texts, lists = part.column("text").to_pylist(), part.column("__hits").to_pylist()
            removed, out, shas = [], [], part.column("__sha").to_pylist()
            for i, (text, lists_) in enumerate(zip(texts, lists, strict=True)):
                gone = 0
                if lists_:
                    kept, gone = _without(text.encode(), np.frombuffer(b"".join(lists_), np.int64), n)
                    text = kept.decode()
                if digest and shas[i] is None:
                    shas[i] = hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest()
                removed.append(gone)
                out.append(text)
            counts = [part.column("__n_words"), pa.array(removed, pa.int64())]
            last = pa.array(shas, pa.string()) if digest else pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *counts, last], names=[*keep, "__n_words", "__n_removed", "__last"])

    sent = docs.select(place.alias("__place"), *docs.columns).mapInArrow(
        prepare, f"__place long, {schema}, __text_id long, __n_words long, text string, __sha string"
    )
    joined = sent.join(found, (F.col("__place") == F.col("__doc")) & (F.col("__text_id") == F.col("__text")), "left")
    if digest:
        return joined.select(*keep, "__n_words", "__hits", "text", "__sha").mapInArrow(
            finish, f"{schema}, n_words long, n_removed long, kept_sha256 string"
        )
    done = joined.select(*keep, "__n_words", "__hits", "text", "__sha").mapInArrow(
        finish, f"{schema}, __n_words long, __n_removed long, text string"
    )
    return done.select(*docs.columns, "__n_words", "__n_removed")


def _sha(text) -> str:
    return hashlib.sha256(b" ".join((text.as_py() or "").encode().split())).hexdigest()


def _without(text: bytes, starts: np.ndarray, n: int) -> tuple[bytes, int]:
    words = text.split()  # on the bytes that part words
    gone = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(starts)
    gone[starts] += 1
    gone[np.minimum(starts + n, len(words))] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    return b" ".join([w for w, c in zip(words, covered, strict=True) if not c]), int(covered.sum())
