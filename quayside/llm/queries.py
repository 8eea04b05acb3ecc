"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import (
    bpe,
    decontamination,
    packing,
    quality,
    shallot,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_rollup,
    topk,
    toxicity,
    vector_codes,
    warc,
)
from quayside.llm.common import held_out, read, ship
from quayside.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
WARC_DATE = "2026-01-01T00:00:00Z"  # pages carry no date
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    QUERIES[query.__name__] = run
    return run


@registered
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@registered
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    found = warc.responses(read(spark, sf_dir, "pages"), WARC_DATE)
    return warc.derivatives(found, "page_id").drop("block", "warc_date")


@registered
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without byte strings that occurred before."""
    return suffix_dedup.removals(read(spark, sf_dir, "documents"))


@registered
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@registered
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fold."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~held_out())
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@registered
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every twentieth one."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@registered
def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after five batches: all documents are counted, then
    counted by a second version; exact copies are revised to no tokens; documents labelled toxic are taken down; and
    the first batch and the takedown arrive once more, without effect."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    narrow = docs.select("doc_id", "text", "source", "lang")
    load = token_rollup.events_of(narrow, "words/1", "insert", 1)
    part = token_rollup.part_of(narrow).alias("part")
    hashed = narrow.select("doc_id", part, "source", "lang", F.sha2("text", 256).alias("h"))
    first = hashed.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("first"))
    versions = F.explode(F.array(*[F.lit(v) for v in token_rollup.COUNTERS])).alias("tokenizer")

    def events(rows: DataFrame, op: str, count: int | None) -> DataFrame:
        return rows.select(
            "doc_id",
            "part",
            versions,
            F.lit(1).cast("long").alias("seq"),
            F.lit(op).alias("op"),
            "source",
            "lang",
            F.lit(count).cast("long").alias("n_tokens"),
        )

    copies = hashed.join(first, "h").where("doc_id > first")
    toxic = narrow.select("doc_id", part, "source", "lang").join(labels.where("toxic = 1"), "doc_id", "left_semi")
    takedown = events(toxic, "delete", None)
    rollup.commit("load", load)
    rollup.commit("second-version", token_rollup.events_of(narrow, "words/2", "insert", 1))
    rollup.commit("copies", events(copies, "revise", 0))
    rollup.commit("takedown", takedown)
    rollup.compact()
    rollup.commit("takedown", takedown)
    rollup.commit("load", load)
    return rollup.totals()


@registered
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@registered
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 50-word passages of earlier documents."""
    return substring_dedup.removals(read(spark, sf_dir, "documents"))


@registered
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), with_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@registered
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and exact squared distance of every vector after five rounds from forty centroids."""
    return shallot.report(read(spark, sf_dir, "embeddings"))


@registered
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector by eight codebooks of sixteen entries, trained for six rounds."""
    return vector_codes.report(read(spark, sf_dir, "embeddings"))


@registered
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark that every document holds verbatim."""
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


WORDS = r"[^\x20\x09-\x0D]+"


def _literal(text: str) -> str:
    """A pattern as a DuckDB string that may hold escapes."""
    return "'" + text.replace("'", "''") + "'"


def _sql_unescaped(text: str) -> str:
    """Reads each character reference once: the text between them and what they stand for, in turns."""

    def listed(values: dict) -> str:
        return "MAP {" + ", ".join(f"{_literal(str(k))}: {_literal(v)}" for k, v in values.items()) + "}"

    code = "(CASE WHEN lower(e[3]) = 'x' THEN ('0x' || e[4:-2])::INT ELSE e[3:-2]::INT END)"
    valid = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) ELSE chr(65533) END"
    one = (
        f"CASE WHEN e IS NULL THEN '' WHEN e[2] = '#' THEN coalesce({listed(warc.WINDOWS)}[{code}::VARCHAR], {valid}) "
        f"ELSE coalesce({listed(warc.NAMED)}[e[2:-2]], e) END"
    )
    found = f"list_transform(regexp_extract_all({text}, {_literal(warc.ENTITY)}), lambda e: {one})"
    between = f"regexp_split_to_array({text}, {_literal(warc.ENTITY)})"
    return f"array_to_string(list_transform(list_zip({between}, {found}), lambda z: z[1] || coalesce(z[2], '')), '')"


def _sql_plain_text(html: str) -> str:
    text = f"regexp_replace({html}, {_literal('(?is)' + warc.HIDDEN)}, ' ', 'g')"
    text = f"regexp_replace({text}, {_literal('(?i)' + warc.BREAKS)}, chr(10), 'g')"
    text = _sql_unescaped(f"regexp_replace({text}, {_literal(warc.TAG)}, '', 'g')")
    text = f"regexp_replace({text}, '[ \\t\\r\\f ]+', ' ', 'g')"
    return f"trim(regexp_replace({text}, ' ?\\n[\\n ]*', chr(10), 'g'), ' ' || chr(10))"


def _sql_id(*parts: str) -> str:
    digest = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    cuts = [f"substr({digest}, {start}, {size})" for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return f"'<urn:uuid:' || concat_ws('-', {', '.join(cuts)}) || '>'"


CRLF = "chr(13) || chr(10)"
ORACLES["op2_warc"] = f"""
WITH s AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS payload,
    'HTTP/1.1 200 OK' || {CRLF} || 'Content-Type: text/html; charset=utf-8' || {CRLF} || 'Content-Length: '
      || strlen(coalesce(html, '')) || {CRLF} AS http,
    {_sql_id("'response'", "coalesce(page_id::varchar, '')", "coalesce(url, '')")} AS refers_to
  FROM pages
), d AS (
  SELECT *, 'sha256:' || sha256(payload) AS source_payload_digest,
    'sha256:' || sha256(http || {CRLF} || payload) AS source_block_digest,
    {_sql_plain_text("payload")} AS txt
  FROM s
), m AS (
  SELECT *, 'title: ' || trim(regexp_replace(regexp_extract(payload, {_literal('(?is)' + warc.TITLE)}, 1),
      '[ \t\r\n\f]+', ' ', 'g'), ' ')
    || {CRLF} || 'outlinks: ' || len(regexp_extract_all(payload, {_literal('(?i)' + warc.LINK)}))
    || {CRLF} || 'text-length: ' || strlen(txt)
    || {CRLF} || 'source-payload-digest: ' || source_payload_digest
    || {CRLF} || 'source-block-digest: ' || source_block_digest || {CRLF}
    || 'HTTP/1.1 200 OK' || {CRLF} || 'source-http-Content-Type: text/html; charset=utf-8' || {CRLF}
    || 'source-http-Content-Length: ' || strlen(payload) || {CRLF} AS meta
  FROM d
), i AS (
  SELECT *, {_sql_id("'metadata'", "refers_to", "md5(meta)")} AS mid,
    {_sql_id("'conversion'", "refers_to", "md5(txt)")} AS tid
  FROM m
)
SELECT page_id, 'metadata' AS warc_type, mid AS record_id, refers_to, tid AS concurrent_to, target_uri,
  'application/warc-fields' AS content_type, source_payload_digest, source_block_digest,
  'sha256:' || sha256(meta) AS block_digest, strlen(meta)::bigint AS content_length FROM i
UNION ALL
SELECT page_id, 'conversion', tid, refers_to, mid, target_uri, 'text/plain; charset=utf-8', source_payload_digest,
  source_block_digest, 'sha256:' || sha256(txt), strlen(txt)::bigint FROM i
"""

ORACLES["op6_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS t
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.t, c.t), lambda p: coalesce(p[1] * p[2], 0))), 0)::bigint AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::int AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op7_token_rollup"] = f"""
WITH d AS (
  SELECT doc_id, source, lang,
    text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text) AS copied,
    coalesce(len(regexp_extract_all(text, {_literal(token_rollup.COUNTERS['words/1'])})), 0) AS n1,
    coalesce(len(regexp_extract_all(text, {_literal(token_rollup.COUNTERS['words/2'])})), 0) AS n2
  FROM (SELECT DISTINCT doc_id, text, source, lang FROM documents)
), e AS (
  SELECT source, lang, unnest(['words/1', 'words/2']) AS tokenizer,
    unnest(CASE WHEN copied THEN [0, 0] ELSE [n1, n2] END) AS n
  FROM d WHERE NOT coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false)
)
SELECT source, lang, tokenizer, count(*)::bigint AS docs, sum(n)::bigint AS tokens
FROM e GROUP BY source, lang, tokenizer
"""

ORACLES["op9_substring_dedup"] = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM documents
), s AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (h) WHERE doc_id > first
), gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM g GROUP BY doc_id),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (
    SELECT w.doc_id, unnest(w.words) AS word, unnest(range(1, len(w.words) + 1)) AS p
    FROM w JOIN gone USING (doc_id)
  ) x ANTI JOIN g USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::bigint AS n_words, coalesce(gone.n, 0)::bigint AS n_removed,
  sha256(CASE WHEN gone.n IS NULL THEN array_to_string(words, ' ') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def _sql_quality() -> str:
    def listed(values: list[str]) -> str:
        return "[" + ", ".join(_literal(v) for v in values) + "]"

    def distance(counts: str, reference: str) -> str:
        """p and q are the shares; the sum runs over the bins."""
        return f"""CASE WHEN list_sum({counts}) > 0 AND list_sum({reference}) > 0 THEN sqrt(greatest(0, list_sum(
          list_transform(list_zip({counts}, {reference}), lambda z: js(z[1] / list_sum({counts}), z[2] / list_sum({reference})))
        ) / 2)) END"""

    def js(p: str, q: str) -> str:
        def half(a: str, b: str) -> str:
            return f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END)"

        return f"({half(p, q)} + {half(q, p)})"

    def expanded(counts: str, reference: str) -> str:
        call = distance(counts, reference)
        inner = f"js(z[1] / list_sum({counts}), z[2] / list_sum({reference}))"
        return call.replace(inner, js(f"(z[1] / list_sum({counts}))", f"(z[2] / list_sum({reference}))"))

    classes = ", ".join(f"len(regexp_extract_all(rest, {_literal(p)}))" for p in quality.CLASSES.values())
    common = ", ".join(
        f"len(list_filter(words, lambda x: x IN ({', '.join(_literal(s) for s, o in quality.SPELLINGS.items() if o == w)})))"
        for w in quality.VOCABULARY
    )
    size = len(quality.CLASSES) + 2
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words,
    regexp_replace(coalesce(text, ''), '{quality.LOWER}', '', 'g') AS rest
  FROM documents
), h AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM (
    SELECT rid, i, array_to_string(words[i:i + 2], ' ') AS g
    FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3))
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM h WHERE n > 1) GROUP BY rid
), l AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '{WORDS}') GROUP BY rid
), b AS (
  SELECT w.*, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars,
    len(regexp_extract_all(rest, {_literal(quality.SYMBOLS)}))::bigint AS n_symbols,
    coalesce(l.n, 0)::bigint AS n_dup_lines, coalesce(r.n, 0)::bigint AS n_repeat_words,
    [length(text) - length(rest), {classes}] AS known, [{common}] AS listed
  FROM w LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)
), c AS (
  SELECT *, list_append(known, length(text) - list_sum(known)::bigint) AS classes,
    list_append(listed, len(words) - list_sum(listed)::bigint) AS common,
    n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed
  FROM b
), e AS (
  SELECT lang, generate_subscripts(list_concat(classes, common), 1) AS bin,
    unnest(list_concat(
      list_transform(classes, lambda x: coalesce(floor(x * 1e6 / nullif(list_sum(classes), 0)), 0)),
      list_transform(common, lambda x: coalesce(floor(x * 1e6 / nullif(list_sum(common), 0)), 0)))) AS n
  FROM c WHERE NOT base_failed AND lang IN ({', '.join(_literal(x) for x in quality.COMMON_WORDS)})
), f AS (
  SELECT lang, list(n ORDER BY bin) AS bins FROM (SELECT lang, bin, sum(n) AS n FROM e GROUP BY lang, bin) GROUP BY lang
), j AS (
  SELECT c.*, bins[1:{size}] AS ref_classes, bins[{size + 1}:] AS ref_common FROM c LEFT JOIN f USING (lang)
), k AS (
  SELECT *, CASE WHEN list_sum(classes) >= {quality.LEAST_CHARS} THEN {expanded("classes", "ref_classes")} END AS dc,
    CASE WHEN n_words >= {quality.LEAST_COMPARED} THEN {expanded("common", "ref_common")} END AS dw
  FROM j
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(dc, 0) <= {quality.MAX_CLASS_DISTANCE} AND coalesce(dw, 0) <= {quality.MAX_WORD_DISTANCE}
    AS kept
FROM k
"""


ORACLES["op10_quality"] = _sql_quality()


FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _sql_floor(total: str, count: str) -> str:
    """Whole-number division that goes down."""
    return f"(({total} - (({total} % {count}) + {count}) % {count}) // {count})"


def _sql_squared(a: str, b: str) -> str:
    terms = f"list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"
    return f"coalesce(list_sum({terms}), 0)::bigint"


def _sql_clustering() -> str:
    steps = []
    for i in range(shallot.ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := d, c := c)) AS b FROM (
    SELECT v.rid, c.c, {_sql_squared("v.t", "c.t")} AS d FROM v, c{i} c) GROUP BY rid
)""")
        if i < shallot.ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.t, c.t) AS t FROM c{i} c LEFT JOIN (
    SELECT c, list(x ORDER BY pos) AS t FROM (
      SELECT c, pos, {_sql_floor("sum(x)::hugeint", "count(*)")}::bigint AS x
      FROM (SELECT b.c AS c, unnest(t) AS x, generate_subscripts(t, 1) AS pos FROM a{i} JOIN v USING (rid))
      GROUP BY c, pos) GROUP BY c) n USING (c)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: floor({shallot.SCALE} * x::double)::bigint) AS t
  FROM embeddings WHERE {FINITE} AND len(embedding) = {shallot.DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT c - 1 AS c, t FROM (
    SELECT row_number() OVER (ORDER BY sha256('{shallot.SEED}' || vec_id) NULLS LAST, t) AS c, t FROM v)
  WHERE c <= {shallot.CLUSTERS}
), {", ".join(steps)}
SELECT vec_id, b.c::int AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::bigint AS cluster_inertia,
  (sum(b.d) OVER ())::bigint AS inertia, sha256(array_to_string(c.t, ',')) AS centroid_sha256
FROM a{shallot.ROUNDS} JOIN v USING (rid) JOIN c{shallot.ROUNDS} c ON c.c = b.c
"""


def _sql_codes() -> str:
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, p, min(struct_pack(d := d, k := k)) AS b FROM (
    SELECT q.rid, q.p, e.k, {_sql_squared("q.s", "e.s")} AS d FROM q JOIN e{i} e USING (p)) GROUP BY rid, p
)""")
        if i < rounds:
            steps.append(f"""e{i + 1} AS MATERIALIZED (
  SELECT e.p, e.k, coalesce(n.s, e.s) AS s FROM e{i} e LEFT JOIN (
    SELECT p, k, list(x ORDER BY pos) AS s FROM (
      SELECT p, k, pos, {_sql_floor("sum(x)::hugeint", "count(*)")}::bigint AS x
      FROM (SELECT p, b.k AS k, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM a{i} JOIN q USING (rid, p))
      GROUP BY p, k, pos) GROUP BY p, k) n USING (p, k)
)""")
    return f"""
WITH f AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::double)::bigint) AS t
  FROM embeddings WHERE {FINITE}
), w AS (SELECT (ceil(max(len(t)) / {parts}))::bigint AS width FROM f),
v AS MATERIALIZED (
  SELECT rid, vec_id, label, width, row_number() OVER (ORDER BY vec_id NULLS LAST, t) - 1 AS place,
    list_resize(t, width * {parts}, 0) AS t FROM f, w
), q AS MATERIALIZED (
  SELECT rid, place, p, t[p * width + 1:(p + 1) * width] AS s FROM v, range({parts}) r(p)
), e0 AS MATERIALIZED (SELECT p, place AS k, s FROM q WHERE place < {entries}),
{", ".join(steps)},
m AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM e{rounds}),
o AS (
  SELECT rid, string_agg(printf('%02x', b.k), '' ORDER BY p) AS code, sum(b.d)::bigint AS error FROM a{rounds} GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256
FROM o JOIN v USING (rid), m
"""


ORACLES["op11_centroid_clustering"] = _sql_clustering()
ORACLES["op12_vector_codes"] = _sql_codes()

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TEST_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLES["op13_decontamination"] = f"""
WITH i AS (
  SELECT coalesce(item_id::varchar, '') AS item, words, least({decontamination.WINDOW}, len(words)) AS m
  FROM (SELECT item_id, {_TEST_WORDS} AS words FROM benchmark) WHERE len(words) > 0
), t AS (
  SELECT DISTINCT item, m, array_to_string(words[j:j + m - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS j FROM i)
), d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TEST_WORDS} AS words FROM documents),
s AS (
  SELECT rid, j, m, array_to_string(words[j:j + m - 1], ' ') AS w
  FROM (SELECT rid, words, m, unnest(range(1, len(words) - m + 2)) AS j
    FROM d, (SELECT DISTINCT m FROM t) WHERE len(words) >= m)
), h AS MATERIALIZED (SELECT rid, j, m, item FROM s JOIN t USING (m, w)),
n AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(j, j + m)) AS p FROM h) GROUP BY rid
), k AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid
)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""
