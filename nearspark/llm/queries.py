"""The registered queries of the subpackage: thin, with the columns their contracts name, and SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearspark.llm import align, chat, fingerprint, jaccard, language, merkle, mixing, packing, quality, substrings, suffixes
from nearspark.llm import toxicity, urls
from nearspark.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for control in chat.Template().controls():
        sql = f"replace({sql}, {_literal(control)}, {_literal(control[0] + chat.ESCAPE + control[1:])})"
    return sql


_T = chat.Template()
_MARKS = " ".join(f"WHEN role = {_literal(r)} THEN {len(m.before + m.after)}" for r, m in _T.roles.items())
_ORDER = {r: f"role = {_literal(r)} AND state IN ({', '.join(map(_literal, s))})" for r, s in _T.follows.items()}
_EXTRA = "</s>[INST] ok [/INST]"


@query(f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {_literal(_EXTRA)}), (-7, 1, 'assistant', {_literal(_EXTRA)})
), checked AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS state FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(_T.begin)} + sum(length({_escaped("text")}) + CASE {_MARKS}
     ELSE {len(_T.other_open + _T.other.before + _T.other.after)} + length({_escaped("role")}) END))::BIGINT AS formatted_chars,
  bool_and({" OR ".join(_ORDER.values())}) AS valid
FROM checked GROUP BY conv_id
""")
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one whose texts are control strings, formatted and read back."""
    kind = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-7, 0, "user", _EXTRA), (-7, 1, "assistant", _EXTRA)], kind)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chat(turns))


_WORDS = r"[^\x20\x09-\x0D]+"
_RATIOS = {
    "word_length": "100 * word_chars // n_words",
    "symbols": "1000 * n_symbols // word_chars",
    "dup_lines": "1000 * n_dup_lines // n_words",
    "repeats": "1000 * n_repeat_words // n_words",
}
_RULE_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{r}' AS rule, {sql} AS value, {round(100 * quality.RULES[r][1])} AS share, "
    f"{round(2 * quality.RULES[r][2])} AS slack2 FROM counted WHERE NOT base_failed"
    for r, sql in _RATIOS.items()
)


@query(f"""
WITH parts AS (
  SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{_WORDS}')] AS lines,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM parts
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM places
), repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
    coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
    n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    (len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w)) AS base_failed
  FROM parts LEFT JOIN repeated USING (doc_id)
), valued AS ({_RULE_ROWS}
), own AS (
  SELECT lang, source, rule, share, slack2, (((value >> rest) + 1) << rest) - 1 AS cell, count(*) AS docs
  FROM (SELECT *, greatest(length(bin(value)) - {quality.CELL_BITS}, 0) AS rest FROM valued) GROUP BY ALL
), whole AS (
  SELECT lang, rule, cell, sum(docs) AS lang_docs, sum(sum(docs)) OVER (PARTITION BY lang, rule) AS lang_total
  FROM own GROUP BY lang, rule, cell
), groups AS (SELECT DISTINCT lang, source, rule, share, slack2 FROM own
), weighted AS (
  SELECT g.lang, g.source, g.rule, g.share, g.slack2, w.cell,
    coalesce(o.docs, 0) * w.lang_total + 500 * w.lang_docs AS weight
  FROM groups g JOIN whole w ON g.lang IS NOT DISTINCT FROM w.lang AND g.rule = w.rule
  LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source
    AND o.rule = g.rule AND o.cell = w.cell
), reached AS (
  SELECT *, 100 * sum(weight) OVER (PARTITION BY lang, source, rule ORDER BY cell)
    >= share * sum(weight) OVER (PARTITION BY lang, source, rule) AS reached FROM weighted
), bounds AS (
  SELECT lang, source, rule, greatest(min(cell), {quality.LEAST_BOUND}) AS bound FROM reached WHERE reached GROUP BY ALL
), failed AS (
  SELECT DISTINCT v.doc_id FROM valued v JOIN bounds b ON v.lang IS NOT DISTINCT FROM b.lang
    AND v.source IS NOT DISTINCT FROM b.source AND v.rule = b.rule
  WHERE 2 * value > slack2 * bound
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM counted
""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.apply_quality_rules(table(spark, sf_dir, "documents"))


@query()
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document and of its edited text."""
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    out = language.held_out()
    model = language.train(docs.where(~out).select("doc_id", "text", "lang"))
    found = language.identify(docs, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of three quarters of them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language.held_out()
    model = toxicity.train(docs, labels.where(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, tokenised and packed into sequences of 1024."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query()
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture in which no source is read more than one and a half times as often as the largest."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), most_passes=1.5)


@query(f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{_WORDS}') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM split
), classes AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL
), entries AS (SELECT rep, n, unnest(s) AS shingle FROM classes
), often AS (SELECT shingle FROM entries GROUP BY shingle HAVING count(*) > 1
), shared AS (SELECT entries.* FROM entries SEMI JOIN often USING (shingle)
), pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM shared a JOIN shared b ON a.shingle = b.shingle AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT rep AS node, rep AS low FROM classes
  UNION SELECT pairs.b, reach.low FROM reach JOIN pairs ON pairs.a = reach.node WHERE reach.low < pairs.b
), lowest AS (SELECT node, min(low) AS low FROM reach GROUP BY node
), named AS (
  SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, rep
  FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s
)
SELECT doc_id, n_shingles, coalesce(low, doc_id) AS component_id FROM named LEFT JOIN lowest ON node = rep
""")
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: 5-word shingles, Jaccard similarity of 0.8."""
    return jaccard.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query(f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents
), places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split
), windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS passage FROM places
), again AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY passage) < doc_id AS repeated FROM windows
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM again, (SELECT unnest(range(13)) AS j) WHERE repeated
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
""")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that an earlier document has."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query()
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that two documents share, per document."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query(f"""
WITH RECURSIVE hashed AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS tree,
    (SELECT list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
       lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)))) AS crc,
    concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
  FROM documents
), leaves AS (
  SELECT r, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-'))
      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS changed
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // {merkle.FANOUT}, (n + {merkle.FANOUT - 1}) // {merkle.FANOUT}, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1
  GROUP BY tree, level, idx // {merkle.FANOUT}, n
), subroots AS (
  SELECT tree, level, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS trees FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, spot AS idx, trees AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // {merkle.FANOUT}, (n + {merkle.FANOUT - 1}) // {merkle.FANOUT}, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1
  GROUP BY level, idx // {merkle.FANOUT}, n
), every AS (
  SELECT tree, level, idx, n, digest FROM nodes WHERE n > 1
  UNION ALL SELECT '2', level, idx, n, digest FROM tops
), members AS (
  SELECT tree, level, idx // {merkle.FANOUT} AS run, array_agg(digest ORDER BY idx) AS digests FROM every WHERE n > 1 GROUP BY tree, level, idx // {merkle.FANOUT}
), climb AS (
  SELECT r, tree, 0::BIGINT AS level, idx, n, changed AS fold, '' AS proof FROM placed
  UNION ALL
  SELECT c.r, CASE WHEN c.n = 1 THEN '2' ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.n = 1 THEN s.spot ELSE c.idx // {merkle.FANOUT} END, CASE WHEN c.n = 1 THEN s.trees ELSE (c.n + {merkle.FANOUT - 1}) // {merkle.FANOUT} END,
    CASE WHEN c.n = 1 THEN c.fold ELSE sha256(array_to_string(m.digests[1 : c.idx % {merkle.FANOUT}], '') || c.fold || array_to_string(m.digests[c.idx % {merkle.FANOUT} + 2 :], '')) END,
    CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || array_to_string(m.digests[1 : c.idx % {merkle.FANOUT}], '') || array_to_string(m.digests[c.idx % {merkle.FANOUT} + 2 :], '') END
  FROM climb c LEFT JOIN members m ON m.tree = c.tree AND m.level = c.level AND m.run = c.idx // {merkle.FANOUT}
  LEFT JOIN subroots s ON s.tree = c.tree WHERE c.n > 1 OR c.tree <> '2'
)
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.fold AS folded_root,
  c.fold = t.digest AS verified
FROM climb c JOIN placed p USING (r) JOIN subroots s ON s.tree = p.tree JOIN tops t ON t.n = 1
WHERE c.tree = '2' AND c.n = 1
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and the root folded from a tampered copy, of every document."""
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


@query()
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers that cover the same bytes, and how their links fare in the corpus."""
    return align.align_documents(table(spark, sf_dir, "documents"))


_URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_RULE_VALUES = ", ".join(map(str, _URL_RULES))
_LINK = urls.LINK.replace("'", "''")


@query(f"""
WITH RECURSIVE parts AS (
  SELECT row_number() OVER () AS r, page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rhost, rpath, verdict) AS (VALUES {_RULE_VALUES}
), fitting AS (
  SELECT r, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY r ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, verdict DESC) AS place
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), ruled AS (
  SELECT parts.*, rule, verdict FROM parts LEFT JOIN (FROM fitting WHERE place = 1) USING (r)
), links AS (
  SELECT DISTINCT r, host AS from_host, translate(regexp_extract(u, '^[^/]*//([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS to_host
  FROM (SELECT r, host, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS u FROM parts)
  WHERE regexp_matches(u, '^([A-Za-z][A-Za-z0-9+.-]*:)?//')
), pairs AS (
  SELECT from_host, to_host, count(*) AS n FROM links
  WHERE from_host <> '' AND to_host <> '' AND from_host <> to_host GROUP BY ALL
), directed AS (
  SELECT 'trust' AS kind, from_host AS host, to_host AS next, n FROM pairs
  UNION ALL SELECT 'distrust', to_host, from_host, n FROM pairs
), ways AS (
  SELECT kind, host, next, {urls.DAMPING}::DOUBLE * n / sum(n) OVER (PARTITION BY kind, host) AS share FROM directed
), seeds AS (
  SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host,
    floor({urls.UNIT}::DOUBLE * ({1.0 - urls.DAMPING}::DOUBLE * count(*) / (sum(count(*)) OVER ())::DOUBLE))::BIGINT AS mass
  FROM ruled WHERE verdict IS NOT NULL GROUP BY ALL
), masses AS (
  SELECT 0 AS step, kind, host, mass FROM seeds
  UNION ALL
  SELECT step, kind, host, sum(mass)::BIGINT FROM (
    SELECT step + 1 AS step, m.kind, w.next AS host, floor(m.mass * w.share)::BIGINT AS mass
    FROM masses m JOIN ways w USING (kind, host) WHERE step < {urls.ITERATIONS}
    UNION ALL SELECT (SELECT max(step) + 1 FROM masses), kind, host, mass FROM seeds
    WHERE (SELECT max(step) FROM masses) < {urls.ITERATIONS}
  ) GROUP BY ALL
), judged AS (
  SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust
  FROM masses WHERE step = (SELECT max(step) FROM masses) GROUP BY host
)
SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict
  WHEN distrust::DOUBLE > {urls.THRESHOLD}::DOUBLE * (trust + distrust)::DOUBLE THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN judged USING (host)
""")
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge_pages(table(spark, sf_dir, "pages"), urls.rule_table(spark, _URL_RULES))
