"""Queries of text analysis, chunking, sources and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract
from ..functions import text as T
from ..functions.stem import stem_terms
from ..functions.wordlists import STOP_WORDS, SYNONYMS
from ..operators import evaluate as E
from ..operators import index as X
from ..operators import search as S
from ..operators.changefeed import BucketedTable, applicable, newest
from ..session import scratch, spread, table
from ..sources import files
from ..sources.fs import SharedFiles
from ..streaming import feed

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def sql_tokens(column: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({column}, ''), '[A-Z][a-z0-9]*|[a-z0-9]+|[A-Z]+'), lambda t: lower(t)), lambda t: NOT list_contains({_STOP}, t))"


EDGES = "CASE WHEN length(term) > 3 THEN list_concat([term], list_transform(range(3, least(length(term), 10)), lambda i: substring(term, 1, i::INT))) ELSE [term] END"
CODE = """CASE WHEN regexp_replace(upper(term), '[^A-Z]', '', 'g') = '' THEN '' ELSE rpad(regexp_replace(upper(term), '[^A-Z]', '', 'g')[1] || array_to_string(
  list_filter(string_split(translate(regexp_replace(upper(term), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202'), ''),
    lambda x, i: i > 1 AND x <> '0' AND x <> translate(regexp_replace(upper(term), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')[i - 1])[:3], ''), 4, '0') END"""
TOK = f"""
WITH docs AS (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM docs, unnest(toks) AS u(term) GROUP BY ALL),
dl AS (SELECT doc_id, len(toks)::BIGINT AS dl FROM docs),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM tf GROUP BY term),
n AS (SELECT count(*) AS n, coalesce(sum(dl), 0)::BIGINT AS total_len FROM dl),
q AS (SELECT query_id, {sql_tokens('query_text')} AS toks FROM search_queries),
qt AS (SELECT query_id, term, count(*) AS cnt FROM q, unnest(toks) AS u(term) GROUP BY ALL)
"""


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return X.analysed(spread(table(spark, d, "documents").select("doc_id", "text")))


def tf_of(spark: SparkSession, d: str) -> DataFrame:
    return X.term_freq(docs_of(spark, d))


def vocab_of(spark: SparkSession, d: str) -> DataFrame:
    return X.vocabulary(tf_of(spark, d))


def query_terms_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "search_queries").select("query_id", "query_text")
    return S.query_terms(X.term_freq(X.analysed(rows, "query_id", "query_text"), "query_id"))


@query(TOK + "SELECT doc_id, toks FROM docs")
def tokenize_docs(spark, d):
    return docs_of(spark, d)


@query(TOK + "SELECT doc_id, (i - 1)::INT AS pos, toks[i] AS term FROM docs, unnest(range(1, len(toks) + 1)) AS u(i)")
def token_positions(spark, d):
    return X.token_positions(docs_of(spark, d))


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z0-9]*|[a-z0-9]+|[A-Z]+'))::BIGINT AS all_tokens, len({sql_tokens('text')})::BIGINT AS kept FROM documents")
def stopword_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.raw_tokens("text")).cast("long").alias("all_tokens"), F.size(T.tokens("text")).cast("long").alias("kept"))


@query(TOK + "SELECT doc_id, term, tf FROM tf")
def term_freq(spark, d):
    return tf_of(spark, d)


@query(TOK + "SELECT doc_id, dl FROM dl")
def doc_lengths(spark, d):
    return X.doc_lengths(docs_of(spark, d))


@query(TOK + "SELECT term, df FROM df")
def doc_freq(spark, d):
    return vocab_of(spark, d).select("term", "df")


@query(TOK + "SELECT n, total_len FROM n")
def corpus_stats(spark, d):
    return X.corpus_stats(X.doc_lengths(docs_of(spark, d)))


@query(TOK + "SELECT term, occurrences FROM df")
def vocab_occurrences(spark, d):
    return vocab_of(spark, d).select("term", "occurrences")


@query(TOK + f"SELECT term, fragment FROM (SELECT term, {EDGES} AS f FROM df), unnest(f) AS u(fragment)")
def edge_ngrams(spark, d):
    return vocab_of(spark, d).select("term", F.explode(T.edge_ngrams("term")).alias("fragment"))


@query(TOK + f"SELECT fragment, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {EDGES} AS f FROM tf), unnest(f) AS u(fragment) GROUP BY fragment")
def fragment_postings(spark, d):
    return X.fragments(tf_of(spark, d)).groupBy("fragment").agg(F.count(F.lit(1)).alias("docs"))


@query(TOK + f"SELECT term, {CODE} AS code FROM df")
def soundex_codes(spark, d):
    return vocab_of(spark, d).select("term", T.soundex("term").alias("code"))


@query(TOK + f"SELECT code, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {CODE} AS code FROM tf) WHERE code <> '' GROUP BY code")
def phonetic_postings(spark, d):
    return X.phonetic(tf_of(spark, d)).groupBy("code").agg(F.count(F.lit(1)).alias("docs"))


@query()
def stem_vocab(spark, d):
    return vocab_of(spark, d).select("term", stem_terms("term").alias("stem"))


@query()
def analyze_docs_stemmed(spark, d):
    return X.stemmed_terms(tf_of(spark, d))


@query(r"SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\p{N}+|\p{L}[\p{L}\p{N}]*|[^\t\n\f\r \x0b]'), lambda t: lower(t)) AS toks FROM documents")
def alt_lexer_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.lexer_tokens("text").alias("toks"))


@query()
def alt_lexer_stemmed(spark, d):
    return X.lexed(spread(table(spark, d, "documents").select("doc_id", "text")))


@query(TOK + "SELECT term FROM df WHERE term LIKE 're%' ORDER BY term LIMIT 20")
def prefix_terms(spark, d):
    return vocab_of(spark, d).where(F.col("term").startswith("re")).select("term").orderBy("term").limit(20)


@query(TOK + """, w AS (SELECT DISTINCT substring(term, 1, 4) AS term FROM df)
SELECT w.term, coalesce(known.term, (SELECT min(v.term) FROM df v WHERE starts_with(v.term, w.term)), w.term) AS resolved FROM w LEFT JOIN df known ON known.term = w.term""")
def resolve_terms(spark, d):
    vocab = vocab_of(spark, d)
    return S.resolve(vocab.select(F.substring("term", 1, 4).alias("term")), vocab)


@query(TOK + """, w AS (SELECT DISTINCT term FROM qt)
SELECT w.term, v.term AS near, levenshtein(w.term, v.term)::INT AS distance FROM w JOIN df v ON abs(length(w.term) - length(v.term)) <= 2 AND levenshtein(w.term, v.term) BETWEEN 1 AND 2""")
def fuzzy_terms(spark, d):
    return S.near_terms(query_terms_of(spark, d), vocab_of(spark, d))


_SYN = ", ".join(f"('{k}', [" + ", ".join(f"'{s}'" for s in v) + "])" for k, v in SYNONYMS.items())


@query(f"""WITH s(term, syn) AS (VALUES {_SYN}), q AS (SELECT query_id, {sql_tokens('query_text')} AS toks FROM search_queries),
e AS (SELECT query_id, i, toks[i] AS term FROM q, unnest(range(1, len(toks) + 1)) AS u(i)),
l AS (SELECT query_id, i, unnest(list_concat([e.term], coalesce(syn, []))) AS t, generate_subscripts(list_concat([e.term], coalesce(syn, [])), 1) AS j FROM e LEFT JOIN s USING (term)),
f AS (SELECT query_id, t, min((i, j)) AS place FROM l GROUP BY ALL)
SELECT q.query_id, coalesce((SELECT list(t ORDER BY place) FROM f WHERE f.query_id = q.query_id), []) AS terms FROM q""")
def synonym_expand(spark, d):
    return table(spark, d, "search_queries").select("query_id", T.synonyms_of(T.tokens("query_text")).alias("terms"))


@query(TOK + "SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, n")
def idf_table(spark, d):
    stats = X.corpus_stats(X.doc_lengths(docs_of(spark, d)))
    return vocab_of(spark, d).crossJoin(F.broadcast(stats)).select("term", F.round(S.idf(F.col("n"), F.col("df")), 6).alias("idf"))


_CHUNKED = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 300 THEN [0] ELSE range(0, (ceil((len(w) - 300) / 250.0) * 250)::BIGINT + 1, 250) END) AS s FROM w)
"""


def _chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.word_chunks("text")).alias("idx", "chunk"))


@query(_CHUNKED + "SELECT doc_id, (s // 250)::INT AS idx, array_to_string(w[s + 1:s + 300], ' ') AS chunk FROM c")
def chunk_docs(spark, d):
    return _chunks(spark, d)


@query(_CHUNKED + "SELECT doc_id, doc_id || '||p1||c' || (s // 250) || '||text||0.00,0.00,0.00,0.00' AS chunk_id FROM c")
def chunk_ids(spark, d):
    return _chunks(spark, d).select("doc_id", T.chunk_id("doc_id", F.lit(1), F.col("idx")).alias("chunk_id"))


@query(_CHUNKED + "SELECT doc_id::VARCHAR AS orig_id, 1 AS page, (s // 250)::INT AS idx, 4 AS box FROM c")
def parse_chunk_ids(spark, d):
    p = chunk_ids(spark, d).select(T.parsed_chunk_id("chunk_id").alias("p"))
    return p.select("p.orig_id", "p.page", "p.idx", F.size("p.bbox").alias("box"))


@query(_CHUNKED + "SELECT doc_id::VARCHAR AS doc, 'p1' AS page, 'c' || (s // 250) AS chunk, 'text' AS kind FROM c")
def parse_chunk_fields(spark, d):
    m = chunk_ids(spark, d).select(T.chunk_fields("chunk_id").alias("m"))
    return m.select(F.col("m")["doc_id"].alias("doc"), F.col("m")["page"].alias("page"), F.col("m")["chunk"].alias("chunk"), F.col("m")["type"].alias("kind"))


@query(r"""WITH p AS (SELECT DISTINCT path FROM file_hashes WHERE path IS NOT NULL), s AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM p),
n AS (SELECT path, list_concat([regexp_replace(s[-1], '\.[^.]*$', ''), regexp_extract(s[-1], '\.([^.]*)$', 1)], list_reverse(s)[2:4]) AS n FROM s)
SELECT path, trim(regexp_replace(translate(array_to_string(list_filter(n, lambda x: x <> ''), ' '), '_-.', '   '), ' +', ' ', 'g')) AS words FROM n""")
def path_to_text(spark, d):
    return table(spark, d, "file_hashes").where("path is not null").select("path").distinct().select("path", T.path_words("path").alias("words"))


@query()
def html_visible_text(spark, d):
    return table(spark, d, "documents").select("doc_id", extract.html_text(F.concat(F.lit("<html><title>t</title><script>x()</script><p>"), "text", F.lit("</p></html>"))).alias("visible"))


@query()
def go_source_words(spark, d):
    return table(spark, d, "documents").select("doc_id", extract.go_source_text("text").alias("words"))


@query(r"""SELECT id, request_id, lower(regexp_extract(id, '(\.[^./\\]*)$', 1)) AS ext, lower(regexp_extract(id, '(\.[^./\\]*)$', 1)) IN
('.txt','.md','.log','.csv','.json','.yaml','.yml','.py','.ts','.js','.jsx','.tsx','.rs','.java','.c','.cpp','.h','.html','.htm','.go','.pdf','.jpg','.jpeg','.png','.gif','.bmp','.webp','.tiff','.tif') AS supported FROM index_requests""")
def supported_files(spark, d):
    return table(spark, d, "index_requests").select("id", "request_id", extract.extension("id").alias("ext"), extract.supported("id").alias("supported"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("""SELECT DISTINCT r.id, r.request_id FROM index_requests r WHERE r.id IS NOT NULL AND r.data IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM file_hashes h WHERE h.path = r.id AND lower(h.sha256) = sha256(r.data))""")
def changed_files_antijoin(spark, d):
    req = table(spark, d, "index_requests").where("id is not null and data is not null").select("id", "request_id", F.sha2(F.col("data").cast("binary"), 256).alias("sha")).distinct()
    marks = table(spark, d, "file_hashes").select(F.col("path").alias("id"), F.lower("sha256").alias("sha")).distinct()
    return req.join(marks, ["id", "sha"], "left_anti").select("id", "request_id")


_EVENTS = "WITH e AS (SELECT user_id::VARCHAR AS key, event_id AS seq, event_type = 'error' AS deleted, value FROM events), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) "


def _event_changes(df: DataFrame) -> DataFrame:
    gone = F.col("event_type") == "error"
    return df.select(F.col("event_id").alias("seq"), F.when(gone, "delete").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("key"), F.when(~gone, F.col("value").cast("string")).alias("value"))


@query(_EVENTS + "SELECT key, seq, deleted FROM l")
def upsert_lww(spark, d):
    return newest(applicable(_event_changes(table(spark, d, "events")))).select("key", "seq", "deleted")


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.event_id >= e.event_id)")
def delete_antijoin(spark, d):
    """Events that no later deletion of their user covers."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    gone = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("upto"))
    return e.join(gone, (e.user_id == gone.user_id) & (gone.upto >= e.event_id), "left_anti").select("event_id")


@query(_EVENTS + "SELECT key, seq FROM l WHERE NOT deleted")
def compact_tombstones(spark, d):
    t = BucketedTable(spark, scratch(spark, "compact"), 8)
    changes = _event_changes(table(spark, d, "events"))
    t.apply(changes.where("seq % 2 = 1"))
    t.apply(changes.where("seq % 2 = 0"))
    t.compact()
    return t.state().select("key", "seq")


@query(_EVENTS + "SELECT key, seq FROM l WHERE NOT deleted")
def stream_upsert(spark, d):
    at = scratch(spark, "stream")
    source = f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    if not SharedFiles(spark, f"{d}").is_folder("events.parquet"):  # a stream reads folders
        spark.read.parquet(source).write.parquet(f"{at}/source")
        source = f"{at}/source"
    return feed.replayed(spark, source, schema, _event_changes, at).select("key", "seq")


@query(r"""SELECT id, coalesce(id <> '' AND octet_length(id::BLOB) <= 512 AND NOT regexp_matches(id, '[\x00-\x1f\x{FFFD}]') AND NOT contains(id, '||'), false) AS ok FROM (SELECT DISTINCT id FROM index_requests)""")
def validate_ids(spark, d):
    return table(spark, d, "index_requests").select("id").distinct().select("id", T.valid_id("id").alias("ok"))


@query(r"SELECT doc_id, regexp_replace(text, '[\x00\x{FFFD}]', '', 'g') AS clean, coalesce(regexp_matches(text, '\S'), false) AS ok FROM documents")
def sanitise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sanitised("text").alias("clean"), T.valid_text("text").alias("ok"))


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(value) FILTER (WHERE i = floor(n * 0.95)) AS p95, max(value) FILTER (WHERE i = floor(n * 0.99)) AS p99 FROM v GROUP BY event_type""")
def percentile_nearest_rank(spark, d):
    return E.nearest_rank_percentiles(table(spark, d, "events"), "value", ["event_type"])


@query("""SELECT ts, strftime(ts, '%Y-%m-%d %H:%M:%S') || '  ' || CASE WHEN length(event_type) < 10 THEN rpad(event_type, 10, ' ') ELSE event_type END || ' ' || props AS line FROM events
WHERE contains(upper(strftime(ts, '%Y-%m-%d %H:%M:%S') || '  ' || CASE WHEN length(event_type) < 10 THEN rpad(event_type, 10, ' ') ELSE event_type END || ' ' || props), 'ERROR') ORDER BY ts DESC, line DESC LIMIT 50""")
def log_filter_tail(spark, d):
    rows = table(spark, d, "events").select("ts", F.col("event_type").alias("event"), F.col("props").alias("detail"))
    return files.log_tail(files.log_lines(rows), "error", 50, "ts", "line")


@query("""SELECT query_id, doc_id, CASE WHEN max(kw) FILTER (WHERE isfinite(kw)) OVER (PARTITION BY query_id) <= 0 OR kw IS NULL OR NOT isfinite(kw) OR kw < 0 THEN 0
 ELSE round(least(1, kw / max(kw) FILTER (WHERE isfinite(kw)) OVER (PARTITION BY query_id)), 6) END AS score FROM score_lists""")
def normalised_scores(spark, d):
    finite = F.when(~F.isnan("kw") & (F.abs("kw") != float("inf")), F.col("kw"))
    most = F.max(finite).over(Window.partitionBy("query_id"))
    return table(spark, d, "score_lists").select("query_id", "doc_id", F.round(T.normalised_score("kw", most), 6).alias("score"))


QUERIES = Q
