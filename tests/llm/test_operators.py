"""The operators against brute force, and on NULLs, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearspark.llm import chat, fingerprint, jaccard, language, mixing, packing, quality, substrings, suffixes, toxicity
from nearspark.llm.graph import components
from nearspark.llm.words import Words, sequence_hashes, slices, starts_within, text_bytes
from nearspark.session import cut_lineage

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, cls string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=5, n=120):
    """Copies, near copies, shared passages; then the odd rows."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    sentence = lambda k: [draw.choice(vocabulary) for _ in range(k)]
    passage, base = sentence(60), sentence(90)
    texts = []
    for i in range(n):
        words = sentence(draw.choice([1, 4, 30, 80, 150]))
        if i % 6 == 0:
            words = base[:]
            for _ in range(i % 5):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        if i % 4 == 1:
            words[len(words) // 2 : len(words) // 2] = passage[draw.randrange(8) :]
        texts.append(draw.choice([" ", "  ", " \t"]).join(words) + ("\n" + " ".join(words[:5])) * (i % 3))
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}") for i, t in enumerate(texts)]
    odd = [None, "", " \n\t ", "one", "a b c d e", "x " * 6000, "Ünïcödé 漢字 " * 40, "123 456", "<|endoftext|> a", "a\n\na\na"]
    rows += [(n + i, t, None, None) for i, t in enumerate(odd)]
    rows += [rows[0], rows[6], (None, texts[0], "en", None), (None, None, None, None)]  # repeated rows, no id
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, 0.5, "p", "c") for r in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def split(text):
    return WORD.findall((text or "").encode())


# ---- words -----------------------------------------------------------------------------------------------------


def test_words_and_windows(rows):
    column = pa.array([r[1] for r in rows])
    words = Words(*text_bytes(column))
    assert words.counts.tolist() == [len(split(r[1])) for r in rows]
    hashes = words.hashes()
    flat = [w for r in rows for w in split(r[1])]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    want = {}
    at = starts_within(words.row, 3)
    assert len(at) == sum(max(0, len(split(r[1])) - 2) for r in rows)
    for i, h in zip(at, sequence_hashes(hashes, 3)[at].tolist(), strict=True):
        assert want.setdefault(tuple(flat[i : i + 3]), h) == h
    assert len(set(want.values())) == len(want)
    one = Words(*text_bytes(pa.array(["ab " * (1 << 20)])))  # longer than a slice
    assert len(set(one.hashes().tolist())) == 1 and one.counts.tolist() == [1 << 20]


# ---- 1 ---------------------------------------------------------------------------------------------------------


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "[[INST]", "<<s>", "", None, "[/SYS", "\\\\[OUT]\\", "a\nb"]
    rows = [(c, t, role, hard[(c + t) % len(hard)]) for c in range(12) for t, role in enumerate(["user", "assistant"] * 2)]
    rows += [(50, 1, "user", "x"), (50, 1, "user", "x"), (51, 0, "[ROLE]", "[TURN] y"), (51, 1, None, "z"), (None, 0, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    formatted = chat.format_chat(turns)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort()
        said = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[0]["valid"] and not got[50]["valid"] and not got[51]["valid"]
    bodies = formatted.select("role", F.col("segments")[F.size("segments") - 2]["text"].alias("t")).collect()
    assert not [b for b in bodies for c in chat.Template().controls() if c in b["t"]]
    assert chat.read_back(chat.format_chat(turns.limit(0))).count() == 0


# ---- 2 ---------------------------------------------------------------------------------------------------------


def test_exponent():
    tokens = [1000, 100, 10]
    a = mixing.fit_exponent(tokens, 0.9, None, None)
    assert mixing.entropy(mixing.weights(tokens, a)) == pytest.approx(0.9)
    a = mixing.fit_exponent(tokens, None, 1.5, None)
    assert mixing.repetition(tokens, mixing.weights(tokens, a), None) == pytest.approx(1.5)
    assert mixing.fit_exponent(tokens, 1.2, None, None) == pytest.approx(0, abs=1e-9)  # above what is possible
    assert mixing.fit_exponent([], 1.0, 2.0, None) == 0


def test_mixing(spark, docs, none, rows):
    got = mixing.mix_sources(docs, most_passes=1.5).collect()
    units = {(r[3], r[0]) for r in rows}
    assert {(r["source"], r["doc_id"]) for r in got} == units  # none is left out
    tokens, used, weight = Counter(), Counter(), {}
    for r in rows:
        tokens[r[3]] += len(split(r[1]))
    for r in got:
        used[r["source"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
        assert 0 <= r["progress"] <= 1
    for s, t in tokens.items():
        assert used[s] <= 1.5 * t + 6100  # the last document of the last epoch may reach beyond
        assert abs(used[s] - weight[s] * sum(used.values())) <= 6100 + 0.05 * sum(used.values())
    keys = Counter((r["source"], r["doc_id"], r["epoch"]) for r in got)
    assert max(keys.values()) == 1
    places = defaultdict(set)
    for r in got:
        places[r["block"]].add(r["place"])
    assert all(p == set(range(len(p))) for p in places.values())
    whole = mixing.mixed_documents(docs, most_passes=1.5)
    assert whole.columns == docs.columns and whole.count() >= len(rows)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    half = mixing.mix_sources(docs, most_passes=None, budget=2000).agg(F.sum("n_tokens")).first()[0]
    assert 2000 <= half <= 2000 + 5 * 6100


# ---- 3 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("per_range", [40_000, 11])
def test_suffixes(docs, rows, none, monkeypatch, per_range):
    monkeypatch.setattr(suffixes, "ROWS_PER_RANGE", per_range)
    words, found = defaultdict(list), defaultdict(set)
    for r in rows:
        words[r[0]].append(split(r[1]))
    windows, short = defaultdict(set), defaultdict(set)
    for d, texts in words.items():
        for w in texts:
            for i in range(len(w) - 49):
                windows[tuple(w[i : i + 50])].add(d)
            for i in range(len(w) - 24):
                short[tuple(w[i : i + 25])].add(d)
    for r in suffixes.repeated_passages(docs).collect():
        assert r["n_words"] >= 50
        found[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    for d, texts in words.items():
        w = texts[0]
        need = {j for i in range(len(w) - 49) if len(windows[tuple(w[i : i + 50])]) > 1 for j in range(i, i + 50)}
        may = {j for i in range(len(w) - 24) if len(short[tuple(w[i : i + 25])]) > 1 for j in range(i, i + 25)}
        assert need <= found[d]
        if d is not None:
            assert found[d] <= may
    assert suffixes.repeated_passages(none).count() == 0


def test_ranges_and_word_hashes_take_little_memory():
    """op3: a range's rows are compared as numbers, and words are hashed a part at a time."""
    draw = np.random.default_rng(3)

    def peak(work):
        tracemalloc.start()
        out = work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    column = [draw.integers(0, 2, draw.integers(0, 51)).astype(">u4").tobytes() for _ in range(40_000)]
    column[-3:] = [b"", b"", column[0]]
    links, most = peak(lambda: suffixes._links(pa.array(column, pa.binary())))
    assert links == [0, *suffixes.common_words(column[:-1], column[1:]).tolist()]
    assert most < 12 << 20
    assert suffixes._links(pa.array(column[5:9], pa.binary()).slice(2)) == [0, *suffixes.common_words(column[7:8], column[8:9]).tolist()]
    words = Words(*text_bytes(pa.array(["some words of a text " * 100_000])))
    hashes, most = peak(words.hashes)
    assert len(np.unique(hashes)) == 5 and most < 24 << 20


def test_suffixes_that_one_document_repeats_over_whole_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "ROWS_PER_RANGE", 50)
    texts = [(1, "x " * 300), (2, "x " * 400), (3, "y " * 90)]
    got = suffixes.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:4] for r in got) == [(1, 0, 300, 2), (2, 0, 400, 1)]


@pytest.mark.parametrize("per_range", [40_000, 50])
def test_suffixes_report_only_words_of_shared_windows(spark, docs, rows, monkeypatch, per_range):
    monkeypatch.setattr(suffixes, "ROWS_PER_RANGE", per_range)
    draw = random.Random(8)
    fresh = lambda k: " ".join(f"v{draw.randrange(10**9)}" for _ in range(k))
    one, two, three, whole = fresh(48), fresh(48), fresh(48), fresh(60)
    half = " ".join(whole.split()[:50])
    texts = [f"{fresh(5)} {one} {two} {fresh(9)}", f"{one} {fresh(60)} {three}", f"{fresh(40)} {two}", f"{whole} {three} {one}",
             f"{fresh(7)} {half} {one}"]
    texts = [(1000 + i, t) for i, t in enumerate(texts)]
    # all rows of a doc_id are one document, judged by the places in any of them
    part = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    words, windows, found, want = defaultdict(list), defaultdict(set), defaultdict(set), defaultdict(set)
    for d, text in [(r[0], r[1]) for r in rows] + texts:
        words[d].append(split(text))
    for d, own in words.items():
        for w in own:
            for i in range(len(w) - 49):
                windows[tuple(w[i : i + 50])].add(d)
    for d, own in words.items():
        for w in own:
            want[d] |= {j for i in range(len(w) - 49) if len(windows[tuple(w[i : i + 50])]) > 1 for j in range(i, i + 50)}
    for r in suffixes.repeated_passages(part).collect():
        found[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
        assert r["copy_doc_id"] != r["doc_id"]
    assert found == {d: x for d, x in want.items() if x}
    assert found.keys() & {1000 + i for i in range(5)} == {1003, 1004}


# ---- 4 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_packing_solver(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 64, 1024])
    counts = Counter(draw.randint(1, capacity) for _ in range(draw.choice([1, 50, 800])))
    patterns = packing.solve(dict(counts), capacity)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= capacity and times > 0
        for s in pattern:
            used[s] += times
    assert used == counts
    total = sum(s * n for s, n in counts.items())
    assert sum(t for _, t in patterns) <= max(-(-total // capacity) * 11 // 9 + 1, sum(n for s, n in counts.items() if 2 * s > capacity) + 1)


def test_dominance_is_optimal_on_small_cases():
    def best(items, capacity):
        found = [len(items)]

        def place(i, bins):
            if len(bins) >= found[0]:
                return
            if i == len(items):
                found[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                    place(i + 1, [*bins[:b], bins[b] + items[i], *bins[b + 1 :]])
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return found[0]

    for seed in range(40):
        draw = random.Random(seed)
        items = sorted((draw.randint(3, 20) for _ in range(9)), reverse=True)
        left = dict(Counter(items))
        fixed = packing.reduce_dominated(left, 20)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + best(sorted(rest, reverse=True), 20) == best(items, 20)


def test_packing(docs, rows, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for d, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64
        cuts = [0] * bool(first) + list(range(first, len(ids), 64))
        for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            want[d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack_documents(docs, 64).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= 1.02 * -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack_documents(none).count() == 0


# ---- 5 ---------------------------------------------------------------------------------------------------------


def test_ppm_code_lengths():
    draw = random.Random(1)
    text = [draw.choice([0, 0, 0, 1, 2, 26]) for _ in range(400)]
    grams = Counter(tuple([26] * 3 + text)[i : i + 4] for i in range(len(text)))
    counts = np.zeros(language.SYMBOLS**4)
    for g, n in grams.items():
        counts[((g[0] * 40 + g[1]) * 40 + g[2]) * 40 + g[3]] = n

    def chance(context, symbol):
        if context is None:
            return 1 / language.SYMBOLS
        seen = Counter()
        for g, n in grams.items():
            if g[3 - len(context) : 3] == context:
                seen[g[3]] += n
        n, d = sum(seen.values()), len(seen)
        shorter = context[1:] if context else None
        if not n:
            return chance(shorter, symbol)
        return seen[symbol] / (n + d) if seen[symbol] else d / (n + d) * chance(shorter, symbol)

    bits = language.code_lengths(counts)
    for context in [(0, 0, 0), (0, 1, 2), (9, 9, 9), (9, 9, 0), (26, 26, 26)]:
        for symbol in (0, 1, 2, 5, 26):
            at = ((context[0] * 40 + context[1]) * 40 + context[2]) * 40 + symbol
            assert bits[at] == pytest.approx(-np.log2(chance(context, symbol)))


def test_language(spark, docs, none):
    texts = {"en": "the cat sat on the mat and then the dog came in", "fr": "le chat est là où l'été était passé déjà"}
    known = spark.createDataFrame([(i, texts[k], k) for i in range(20) for k in texts], "doc_id long, text string, lang string")
    model = language.train(known)
    asked = [(1, "the dog sat"), (2, "l'été est passé"), (3, None), (4, "12 !?"), (5, ""), (6, "漢字"), (7, "the dog sat")]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"]
    assert got[6]["lang_pred"] in ("en", "fr") and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1]["score"] == got[7]["score"] > 0.5
    assert language.identify(docs, language.train(docs)).count() == docs.count()
    assert language.identify(docs, language.train(none)).where("lang_pred = 'und'").count() == docs.count()
    assert language.identify(none, model).count() == 0


# ---- 6 ---------------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, none):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows, marks = [], []
    for i in range(300):
        text = [draw.choice(words) for _ in range(30)]
        if i % 4 == 0:
            text[draw.randrange(30)] = draw.choice(["Vile!", "vile", "nasty***"])
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 4 == 0)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (0, 1), (9999, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(texts, labels.where("doc_id IS NULL OR doc_id < 200"))
    got = {r["doc_id"]: r for r in toxicity.score(texts, model).collect()}
    assert sum((r["predicted"] == 1) == (i % 4 == 0) for i, r in got.items()) >= 297
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.reject(docs, model).columns == docs.columns
    assert toxicity.score(none, model).count() == 0 == toxicity.score(docs, toxicity.train(none, labels)).where("predicted = 1").count()


# ---- 7 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_substrings(docs, rows, none, monkeypatch, small):
    if small:  # many shards, hot anchors, and a filter that lets nearly everything through
        for name, value in (("SHARD", 3), ("HOT", 4), ("FILTER_BITS", 7)):
            monkeypatch.setattr(substrings, name, value)
    place = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for d, text, *_ in rows:
        w = split(text)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, 2**63 - 1), place(d))
    want = Counter()
    for d, text, *_ in rows:
        w = split(text)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < place(d) for j in range(i, i + 13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert any(k[2] for k in want)
    assert Counter(map(tuple, substrings.remove_repeats(docs, digest=True).collect())) == want
    if not small:
        whole = substrings.remove_repeats(docs)
        assert whole.columns == [*docs.columns, "__n_words", "__n_removed"]
        texts = Counter((r["doc_id"], hashlib.sha256(b" ".join(split(r["text"]))).hexdigest()) for r in whole.collect())
        assert texts == Counter({(k[0], k[3]): 0 for k in want}) + Counter([(k[0], k[3]) for k, n in want.items() for _ in range(n)])
        assert substrings.remove_repeats(none, digest=True).count() == 0


def test_copies_at_a_hot_anchor_are_spread(spark, monkeypatch):
    for name, value in (("SHARD", 1000), ("HOT", 8)):
        monkeypatch.setattr(substrings, name, value)
    text = " ".join(f"w{i}" for i in range(40))
    same = [(i, text) for i in range(200)] + [(None, text)] * 200
    part = spark.createDataFrame(same, "doc_id long, text string").repartition(4)
    place = F.coalesce("doc_id", F.lit(substrings.LAST)).alias("__place")
    live, recurring = substrings.recurring_windows(part.select(place, "text"), 13)
    groups = []

    class Stop(Exception):
        pass

    def cogroup(self, other):
        groups.append(self._df.groupBy("shard", "salt").agg(F.count("*").alias("n")).collect())
        raise Stop

    from pyspark.sql.group import GroupedData

    with monkeypatch.context() as patch:
        patch.setattr(GroupedData, "cogroup", cogroup)
        with pytest.raises(Stop):
            substrings.locate(part.select(place, "text"), live, recurring, 13)
    sizes = [r["n"] for r in groups[0]]
    assert max(sizes) * 5 < sum(sizes)  # one salt held the stretches of all copies at an anchor
    got = Counter(r["n_removed"] for r in substrings.remove_repeats(part, digest=True).collect())
    assert got == {0: 1, 40: 399}


# ---- 8 ---------------------------------------------------------------------------------------------------------


def test_divide_skip():
    draw = random.Random(2)
    for _ in range(30):
        query = sorted(draw.sample(range(200), draw.randint(1, 60)))
        sets = [sorted({*draw.sample(query, draw.randint(0, len(query))), *draw.sample(range(200), draw.randint(1, 9))}) for _ in range(20)]
        got = jaccard.divide_skip(np.array(query, np.uint64), [np.array(s, np.uint64) for s in sets], (80, 100))
        a = set(query)
        assert got == [i for i, s in enumerate(sets) if 100 * len(a & set(s)) >= 80 * len(a | set(s))]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}


def test_jaccard(docs, rows, none):
    def lower(w):
        return bytes(b + 32 if 65 <= b <= 90 else b for b in w)

    sets = []
    for r in rows:
        w = [lower(x) for x in split(r[1])]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if sets[i] and (same_id or (sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        want[r[0], len(sets[i]), min(ids, default=None)] += 1
    assert Counter(map(tuple, jaccard.near_duplicate_classes(docs).collect())) == want
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {k[2] for k in want if k[2] is not None} | {None}
    assert jaccard.near_duplicate_classes(none).count() == 0


def _near_copies(draw, n, words=80):
    """One group of near copies, of which many pairs do not link, and texts that share one passage alone."""
    base = [f"b{i}" for i in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randint(0, 5)):
            own[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        yield own
    for i in range(n // 2):
        yield [f"s{j}" for j in range(30)] + [f"own{i}_{j}" for j in range(20)]


def _components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("block", [2048, 16])
def test_jaccard_large_group_is_searched_in_blocks(spark, monkeypatch, block):
    texts = list(_near_copies(random.Random(8), 240))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rows = []
    monkeypatch.setattr(jaccard, "cut_lineage", lambda df: rows.append(cut_lineage(df)) or rows[-1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicate_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _components(texts)
    met = next(x for x in rows if x.columns == ["cls", "block", "there"])
    blocks = met.select("there").distinct().count()
    assert blocks > 8 if block == 16 else blocks <= 8
    lonely = {jaccard.class_of(x) for x in jaccard.shingle_sets(pa.array([" ".join(w) for w in texts[240:]]), 5)}
    assert not lonely & {r["cls"] for r in met.collect()}  # one shared passage is too little for a link
    # a class goes once to each block, not to each of the classes that share a list with it
    assert met.count() <= len(texts) * blocks
    links = [x for x in rows if x.columns == ["a", "b"]]
    assert all(x.count() < len(texts) * blocks for x in links)


def test_joining_links_returns_a_forest():
    draw = random.Random(5)
    sets = [np.array(sorted(draw.sample(range(40), 34)), np.uint64) for _ in range(60)]
    own = [True] * 30 + [False] * 30

    def rows(which):
        return pa.table({"cls": pa.array(which, pa.int64()), "comp": pa.array([i // 2 for i in which], pa.int64()),
                         "shingles": pa.array([sets[i].tobytes() for i in which], pa.binary())})

    queries = rows(range(60)).append_column("own", pa.array(own))
    got = jaccard.joining_links(queries, rows(range(30)), (80, 100))
    edges = [(i, j) for i in range(60) for j in range(30) if i // 2 != j // 2 and (not own[i] or j > i)
             and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

    def reach(pairs):
        group = [i // 2 for i in range(60)]
        for a, b in pairs:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
        return group

    assert set(got) <= set(edges) and reach(got) == reach(edges)
    assert 0 < len(got) < 30 + 15  # each joins two components


def test_jaccard_near_copy_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (None, " ".join([*words, "end"])), (None, " ".join([*words, "end"])), (2, "other text")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in jaccard.near_duplicate_classes(docs).collect())))
    assert got == sorted(map(str, [(1, 56, 1), (None, 57, 1), (None, 57, 1), (2, 1, 2)]))
    assert jaccard.drop_near_duplicates(docs).count() == 4  # rows without an id stay


# ---- 9 ---------------------------------------------------------------------------------------------------------


def test_fingerprints(docs, rows, none):
    def digest(text):
        data, counts = (text or "").encode(), [0] * 128
        for j, k, salt in fingerprint.TRIPLETS:
            for i in range(len(data) - k):
                x = (data[i] * 0x9E3779B1 + data[i + j] * 0x85EBCA77 + data[i + k] * 0xC2B2AE3D + salt * 0x27D4EB2F) % 2**32
                x = (x ^ x >> 15) * 0x2C1B3C6D % 2**32
                counts[x >> 25] += 1
        q = [sorted(counts)[i * 32 - 1] for i in (1, 2, 3)]
        codes = [sum(c > x for x in q) for c in counts]
        head = [min(255, round(8 * np.log2(1 + len(data)))), 15 * q[0] // max(q[2], 1) << 4 | 15 * q[1] // max(q[2], 1)]
        return bytes(head + [codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 128, 4)]).hex()

    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    want = Counter()
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        text, following = r[1] or "", after[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, other = digest(text), digest(edited), digest(following)
        near = [round(float(fingerprint.likeness([own], [x])[0]), 9) for x in (changed, other)]
        want[r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, *near] += 1
    for buckets in (None, 40):
        part = docs.select("doc_id", "text")
        if buckets:
            docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "2")
        got = Counter((*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in fingerprint.fingerprint_edits(part).collect())
        docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "8")
        assert got == want
    assert fingerprint.fingerprint(docs).count() == len(rows)
    assert fingerprint.fingerprint_edits(none).count() == 0
    one = docs.where("doc_id = 3")
    assert fingerprint.fingerprint_edits(one).first()["near_next"] == 1.0


# ---- 10 --------------------------------------------------------------------------------------------------------


def test_quality(docs, rows, none):
    want = Counter()
    for d, text, *_ in rows:
        words = [w.decode() for w in split(text)]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        want[d, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), failed] += 1
    got = quality.apply_quality_rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not [r for r in got if r["base_failed"] and r["kept"]] and any(r["kept"] for r in got)
    assert quality.apply_quality_rules(none).count() == 0


def test_sketches_merge(docs):
    counted = quality.count_document_parts(docs, ["doc_id", "lang", "source"]).where(~quality.base_failed())
    ratios = {r: make() for r, (make, _, _) in quality.RULES.items()}
    by = ["lang", "source"]
    parts = [quality.sketch(counted.where(F.abs(F.coalesce("doc_id", F.lit(0))) % 2 == i), by, ratios) for i in (0, 1)]
    whole = quality.sketch(counted, by, ratios)
    assert sorted(map(str, quality.merge(*parts, by=by).collect())) == sorted(map(str, whole.collect()))


def test_long_words_have_bounds(spark):
    draw = random.Random(4)
    text = lambda k: " ".join("".join(draw.choice("abcdefgh") for _ in range(k)) for _ in range(60))
    rows = [(i, "zh", "s", text(11 + i % 2)) for i in range(300)] + [(300, "zh", "s", text(76)), (301, "zh", "s", text(17))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got = {r["doc_id"]: r["kept"] for r in quality.apply_quality_rules(docs).collect()}
    assert [i for i, kept in got.items() if not kept] == [300]
    values = [0, 5, 999, 1000, 1023, 1024, 1025, 7600, 123_456, 2**40 + 1]
    cells = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality._cell(F.col("v")).alias("c")).collect()
    assert all(r["v"] <= r["c"] < r["v"] * (1 + 1 / 512) + 1 and (r["c"] == r["v"] or r["v"] > 1000) for r in cells)


def test_quality_bounds_of_many_documents(spark):
    """Sketches of ten billion documents: products of counts leave the range of long."""
    many = 10_000_000_000
    cells = [("en", "a", "symbols", 3, many), ("en", "a", "symbols", 9, many // 20 - 1), ("en", "b", "symbols", 40, many)]
    sketches = spark.createDataFrame(cells, "lang string, source string, rule string, cell long, docs long")
    got = {r["source"]: r["cell"] for r in quality.thresholds(sketches, ["lang", "source"], 500).collect()}
    assert got == {"a": 3, "b": 40}


def test_quality_long_words_as_in_sql(spark, tmp_path):
    """Words of more than 10 characters are the rule here: code and SQL have the same cells above that."""
    import duckdb

    from nearspark.llm.queries import ORACLES

    draw = random.Random(9)
    rows = [(i, " ".join("x" * draw.randrange(8, 60) + str(draw.random()) for _ in range(60)), "en", f"s{i % 2}") for i in range(400)]
    rows += [(400 + i, " ".join(f"{'y' * 900}{j}{i}" for j in range(60)), "en", "s0") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    result = con.execute(f"SELECT doc_id, kept FROM ({ORACLES['op10_quality_rules']})").fetchall()
    got = quality.apply_quality_rules(spark.read.parquet(str(tmp_path / "d"))).select("doc_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(result)
    assert {k for _, k in result} == {True, False}


def test_substring_extra_columns_of_any_name(spark, rows):
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    more = plain.select("*", *[F.lit(1).alias(c) for c in "abcz"])
    got = substrings.remove_repeats(more)
    assert got.columns == ["doc_id", "text", *"abcz", "__n_words", "__n_removed"]
    assert sorted(map(str, got.drop(*"abcz").collect())) == sorted(map(str, substrings.remove_repeats(plain).collect()))


def test_slices_give_back_what_was_freed():
    def resident():
        import os

        return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    batch = pa.RecordBatch.from_arrays([pa.array(["a b c"] * 10)], names=["text"])
    list(slices([batch]))
    pieces = [bytes([1]) * 10_000 for _ in range(20_000)]
    kept = pieces[::100]  # what stays lies between, so the freed pieces are no tail of the heap
    del pieces
    before = resident()
    assert [p.num_rows for p in slices([batch])] == [10]
    assert before - resident() > 100 << 20
    assert len(kept) == 200
