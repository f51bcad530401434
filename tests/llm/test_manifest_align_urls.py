"""Merkle manifest, tokenizer alignment and URL filters against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspark.llm import align, merkle, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, digest string, row long, pairs string"


def documents(seed=3, n=90):
    draw = random.Random(seed)
    words = ["Ab", "the", "naïve", "漢字", "<s>", "x1", "\n", "  ", "🙂", "Éa"]
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([1, 5, 40]))), draw.choice(["en", "fr"]), "s", 3) for i in range(n)]
    rows += [(n, "Lone", "xx", None, None), (n + 1, None, "en", "s", 0), (n + 2, "", "fr", "s", 0), (n + 3, "Q " * 30000, "fr", "s", 1)]
    rows += [(n + 4, "A▁b", "en", "s", 2), (n + 5, " \t ", None, "", 2), (None, "No id", None, "s", 2), (None, "AB", "en", None, 2)]
    rows += [rows[0], rows[0], rows[4], (7, "Another Text", "en", "s", 3), (n + 6, "a" * 5000, "en", "s", 9)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "l", "t", "d", 5, "p") for r in rows], DOC).repartition(5)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- manifest --------------------------------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def row_sha(doc_id, source, lang, n_chars, text):
    each = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in each))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree_proofs(digests):
    """Root of a tree, and for each leaf the runs on its way: (siblings before, siblings after) level by level."""
    ways, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, at in enumerate(places):
            run = digests[at // 8 * 8 : at // 8 * 8 + 8]
            ways[i].append((run[: at % 8], run[at % 8 + 1 :]))
            places[i] = at // 8
        digests = [sha("".join(digests[i : i + 8])) for i in range(0, len(digests), 8)]
    return digests[0], ways


def manifest_by_hand(rows):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = row_sha(doc_id, source, lang, n_chars, text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        changed = row_sha(doc_id, source, lang, n_chars, lowered(text)) if tampered else leaf
        trees[lang].append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, changed))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for lang in order:
        trees[lang].sort(key=lambda x: x[0])
        inner[lang] = tree_proofs([x[2] for x in trees[lang]])
    root, over = tree_proofs([inner[lang][0] for lang in order])
    out = []
    for place, lang in enumerate(order):
        subroot, ways = inner[lang]
        for (_, doc_id, leaf, changed), way in zip(trees[lang], ways, strict=True):
            fold, siblings = changed, ""
            for before, after in way + over[place]:
                fold = sha("".join(before) + fold + "".join(after))
                siblings += "".join(before + after)
            out.append((doc_id, leaf, subroot, root, sha(siblings), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [200_000, 7])
def test_manifest(docs, rows, monkeypatch, bucket):
    monkeypatch.setattr(merkle, "ROWS_PER_BUCKET", bucket)  # 7: every tree lies over several buckets
    got = collected(merkle.verify_documents(docs))
    assert got == manifest_by_hand(rows)
    assert {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_sizes(spark, n):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(n)]
    got = merkle.verify_documents(spark.createDataFrame([(*r, "l", "t", "d", 5, "p") for r in rows], DOC))
    assert collected(got) == manifest_by_hand(rows)


def test_manifest_of_nothing(spark):
    assert merkle.verify_documents(spark.createDataFrame([], DOC)).collect() == []


def test_row_limit_is_put_back(spark, docs):
    before = spark.conf.get(merkle.ROW_LIMIT)
    merkle.verify_documents(docs)
    assert spark.conf.get(merkle.ROW_LIMIT) == before


# ---- alignment -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tools():
    return align.Tokenizers()


def aligned_by_hand(rows, tools):
    counts, found = Counter(), []
    for doc_id, text in rows:
        a, b = tools(text) if text else ([], [])
        a_end = list(accumulate(len(tools.a_bytes[i]) for i in a))
        b_end = list(accumulate(len(tools.b_bytes[i]) for i in b))
        groups, at = [], [0, 0]
        for end in sorted(set(a_end) & set(b_end)):
            group = []
            for side, (ids, ends) in enumerate(((a, a_end), (b, b_end))):
                start = at[side]
                while at[side] < len(ends) and ends[at[side]] <= end:
                    at[side] += 1
                group.append(ids[start : at[side]])
            groups.append(group)
        links, low = [], 0
        for i, end in enumerate(a_end):
            start = a_end[i - 1] if i else 0
            while b_end[low] <= start:
                low += 1
            j = low
            while j < len(b) and (b_end[j - 1] if j else 0) < end:
                links.append((a[i], b[j]))
                j += 1
        counts.update(links)
        text = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        found.append((doc_id, len(a), len(b), len(groups), links, sha(text) if a else ""))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, digest in found:
        good = sum(counts[x] == best[x[1]] for x in links)
        out.append((doc_id, n_a, n_b, n_groups, len(links), good, sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [1 << 20, 50, 1])
def test_alignment(docs, rows, tools, frequent):
    """However few pairs are broadcast, the result is the same."""
    assert collected(align.align_documents(docs, frequent=frequent)) == aligned_by_hand([r[:2] for r in rows], tools)


def test_ids_are_those_of_the_vocabularies(rows, tools):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    for text in [r[1] for r in rows if r[1]] + ["<|endoftext|> </s> a"]:
        a, _ = tools(text)
        if a:
            assert a == whole.encode(" " + text, add_special_tokens=False).ids
    assert tools("A▁b") == ([], [])  # given back with a blank
    assert tools("<|endoftext|>")[0] and len(tools("<|endoftext|>")[0]) > 1


def test_components_by_doubling():
    draw = random.Random(1)
    for _ in range(200):
        size = draw.randrange(1, 60)
        a, b = (np.array(sorted({*draw.sample(range(1, size + 1), draw.randrange(size)), size})) for _ in range(2))
        a_group, b_group, first, last = align.components(a, b)
        ends = sorted(set(a.tolist()) & set(b.tolist()))
        assert [b[g] for g in a_group] == [next(e for e in ends if e >= x) for x in a]
        assert [b[g] for g in b_group] == [next(e for e in ends if e >= x) for x in b]
        starts = [0, *a[:-1]], [0, *b[:-1]]
        for i in range(len(a)):
            overlap = [j for j in range(len(b)) if starts[1][j] < a[i] and b[j] > starts[0][i]]
            assert (first[i], last[i]) == (overlap[0], overlap[-1])


def test_alignment_of_nothing(spark):
    assert align.align_documents(spark.createDataFrame([], DOC)).collect() == []


# ---- URL filters -----------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string, host string, rule string, verdict string, r int"
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"), ("a.com", "/fr/x", "block"), ("b.a.com", "/fr/", "allow"), ("h1.net", "/", "block"), ("h1.net", "/", "allow"),
    ("com", "/en/", "block"), ("com", "/es/", "block"), ("example.org", "/", "block"),
]


def web(seed=2, n=250):
    draw = random.Random(seed)
    hosts = [f"{h}.{t}" for h in ("h1", "h2", "b.a", "a", "x") for t in ("com", "net", "example.org", "org")]
    rows = []
    for i in range(n):
        links = "".join(
            f"<{draw.choice('aA')} x=1\n{draw.choice(['href', 'HREF'])}={draw.choice([chr(34), chr(39), ' '])}"
            f"{draw.choice(['http://', '//', 'HTTPS://'])}{draw.choice(hosts).upper()}/{k} >z</a>"
            for k in range(draw.randrange(5))
        )
        url = f"http://{draw.choice(hosts)}{draw.choice(['/de/', '/fr/', '/fr/x', '/en/', '/es/', '', '?q=/de/', '#/fr/'])}"
        rows.append((i, url, links + '<a href="/own"><a href=mailto:a@b.org><abbr href="http://no.net/">'))
    odd = [(None, None, None), (n, None, "<a href='//x.net'>"), (n + 1, "no scheme", "<a href='//x.net'>"), (n + 2, "://", "")]
    odd += [(n + 3, "HTTP://UP.Example.ORG/es/1?x://y", None), (n + 4, "http://" + "a." * 3000 + "com/de/", "<a " * 20000)]
    return rows + odd + [rows[5], rows[5]]


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[stop:]
    end = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return lowered(rest[:stop]), path[:end]


def judged_by_hand(rows, rules, iterations=urls.ITERATIONS):
    import re

    ruled, links, seeds = [], Counter(), defaultdict(Counter)
    for page, url, html in rows:
        host, path = parts_by_hand(url)
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, _, verdict, rule = max(fits, default=(0, 0, None, None))
        ruled.append((page, host, path, rule, verdict))
        if verdict:
            seeds[{"allow": "trust", "block": "distrust"}[verdict]][host] += 1
        found = re.findall(r"<[aA][\x20\x09-\x0D][^<>]*?(?i:href)\s*=\s*[\"']?([^\"'<>\s]+)", html or "") if host else []
        for other in {lowered(re.sub(r"[/?#].*", "", x.split("//", 1)[1])) for x in found if re.match(r"([A-Za-z][\w+.-]*:)?//", x)}:
            if other and other != host:
                links[host, other] += 1
    total = sum(sum(x.values()) for x in seeds.values()) or 1
    mass = {}
    for kind in ("trust", "distrust"):
        ways = links if kind == "trust" else Counter({(b, a): n for (a, b), n in links.items()})
        out = Counter()
        for (a, _), n in ways.items():
            out[a] += n
        base = {h: int(float(urls.UNIT) * ((1.0 - urls.DAMPING) * n / total)) for h, n in seeds[kind].items()}
        now = Counter(base)
        for _ in range(iterations if links else 0):
            after = Counter(base)
            for (a, b), n in ways.items():
                if a in now:
                    after[b] += int(now[a] * (urls.DAMPING * n / out[a]))
            now = after
        mass[kind] = now
    bad = {h for h in mass["distrust"] if mass["distrust"][h] > urls.THRESHOLD * (mass["distrust"][h] + mass["trust"][h])}
    return sorted(((*x[:4], x[4] or ("block" if x[1] in bad else "allow")) for x in ruled), key=str)


@pytest.mark.parametrize("rules", [RULES, []])
def test_url_filters(spark, rules):
    rows = web()
    pages = spark.createDataFrame([(*r, "h", "r", "v", 1) for r in rows], PAGE).repartition(4)
    table = urls.rule_table(spark, rules) if rules else spark.createDataFrame([], "host string, path string, verdict string")
    got = collected(urls.judge_pages(pages, table))
    assert got == judged_by_hand(rows, rules)
    if rules:
        assert {(x[3] is None, x[4]) for x in got} == {(a, b) for a in (True, False) for b in ("allow", "block")}


def test_distrust_runs_against_links(spark):
    """Who links to a blocked host is blocked, at two steps as well; whom a trusted host links to is not."""
    chain = [(1, "http://far.net/", "<a href='http://near.net/'>"), (2, "http://near.net/", "<a href='http://bad.com/'>")]
    chain += [(3, "http://bad.com/de/", "<a href='http://victim.net/'>"), (4, "http://good.org/", "<a href='//friend.net'>")]
    chain += [(5, "http://victim.net/", None), (6, "http://friend.net/", "<a href='//bad.com'>"), (7, "http://alone.net/", None)]
    pages = spark.createDataFrame(chain, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_pages(pages, urls.rule_table(spark, RULES)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}


def test_url_filters_of_nothing(spark):
    pages = spark.createDataFrame([], PAGE)
    assert urls.judge_pages(pages, urls.rule_table(spark, RULES)).collect() == []


def test_url_filters_stay_in_the_jvm(spark):
    pages = spark.createDataFrame(web(n=20), "page_id long, url string, html string").where(F.lit(True))
    plan = urls.judge_pages(pages, urls.rule_table(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
