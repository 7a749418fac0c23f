"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from billwright.llm import decontamination, jaccard, mixing, packing, periodic, pii, quality, repeats, tokens, topk, toxicity, trie, warc
from billwright.operators.settle import settle

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op3_benchmark_decontamination",
    rf"""WITH d AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT DISTINCT least(10, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
seen AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, n)),
found AS (SELECT doc_id, item_id, i, size FROM seen JOIN windows USING (size, gram)),
words AS (
  SELECT doc_id, count(DISTINCT word_no) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word_no FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS named
  FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op3(spark, sf_dir):
    return decontamination.hit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op6_warc",
    """WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k""",
)
def op6(spark, sf_dir):
    records = warc.records(table(spark, sf_dir, "pages"), settle=settle)
    archive = settle(warc.chunked(records), "warc")
    return warc.resolve(settle(warc.read_records(archive), "warc-read"))


@query("op10_ngram_jaccard_join")
def op10(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op5_exact_topk",
    """WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM fit q JOIN fit c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
)
def op5(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op1_pii")
def op1(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"), settle)


@query("op7_token_counts")
def op7(spark, sf_dir):
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def labelled_domains(docs, labels):
    """The labelled documents with their language as domain."""
    return docs.select("doc_id", docs["lang"].alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


@query("op8_mixing")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), settle=settle)


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    return periodic.run_report(table(spark, sf_dir, "documents"), places=periodic.repeated_places)


@query("op12_best_fit_packing")
def op12(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def _crc32_sql(digits):
    """CRC-32 of a string of ASCII characters, bit by bit."""
    bits = f"flatten(list_transform(string_split({digits}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_transform(list_concat([4294967295], {bits}), lambda x: CAST(x AS BIGINT)), lambda a, b: {step}), 4294967295)"


@query(
    "op13_conversation_trie",
    f"""WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
begun AS (SELECT c.conv_id, place, role, text FROM c JOIN o ON o.conv_id = c.base AND place < h),
n AS (SELECT c.conv_id, h, count(place) AS n FROM c LEFT JOIN begun USING (conv_id) GROUP BY ALL),
r AS (SELECT * FROM begun UNION ALL SELECT conv_id, place - h + n, role, text FROM o JOIN n USING (conv_id) WHERE place >= h),
p AS (
  SELECT conv_id, place + 1 AS depth, text,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place)) AS k FROM r
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
ends AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
v AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(strlen(text)) AS bytes,
    string_agg(CASE WHEN e THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS named
  FROM (SELECT p.*, ends.depth IS NOT NULL AS e FROM p LEFT JOIN ends USING (conv_id, depth)) GROUP BY depth, k),
up AS (SELECT v.depth, v.k, p.depth AS a_depth, p.k AS a_k FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth),
kids AS (SELECT a_depth AS depth, a_k AS k, count(*) AS n_children FROM up WHERE depth = a_depth + 1 GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM v LEFT JOIN kids USING (depth, k)),
t AS (SELECT a_depth AS depth, a_k AS k, sum(leaf) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens FROM up JOIN w USING (depth, k) GROUP BY ALL),
parents AS (SELECT up.depth, up.k, v.conv_id AS parent_conv_id FROM up JOIN v ON v.depth = up.a_depth AND v.k = up.a_k WHERE up.depth = up.a_depth + 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(named, '')) AS ends_sha256
FROM w JOIN t USING (depth, k) LEFT JOIN parents USING (depth, k)""",
)
def op13(spark, sf_dir):
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))
