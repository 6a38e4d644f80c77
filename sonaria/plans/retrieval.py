"""Text retrieval queries over the documents and conversations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonaria.operators import text as T
from sonaria.operators.bases import merged_chunks, merged_overview, merged_totals
from sonaria.plans.documents import BASES, knowledge_bases
from sonaria.plans.registry import query

_TERMS = ["theand", "tionre", "license", "apache"]
_Q = ", ".join(f"('{t}')" for t in _TERMS)
_BM25 = f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS toks FROM documents),
    s AS (SELECT count(*) AS n, avg(len(toks)) AS avg FROM t), q(term) AS (VALUES {_Q}),
    tf AS (SELECT doc_id, term, len(toks) AS len, len(list_filter(toks, lambda x: x = term)) AS tf FROM t, q), df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1),
    sc AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score FROM tf JOIN df USING (term), s GROUP BY doc_id),
    top AS (SELECT doc_id, score FROM sc WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50)"""


def _tokens(c):
    return c.table("documents").select("doc_id", T.latin_tokens(F.col("text")).alias("tokens"))


@query("bm25_search", "", _BM25 + " SELECT doc_id, round(score, 5) AS score FROM top")
def bm25_search(c):
    return T.bm25_text(c.table("documents"), "doc_id", "text", _TERMS, 50).select("doc_id", F.round("score", 5).alias("score"))


@query("rank_for_rrf", "", _BM25 + " SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM top")
def rank_for_rrf(c):
    w = Window.orderBy(F.desc("score"), "doc_id")  # fifty rows
    return T.bm25_text(c.table("documents"), "doc_id", "text", _TERMS, 50).select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("rank"))


@query("rrf_fuse", "", _BM25 + """, other AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'license') ORDER BY n_chars, doc_id LIMIT 50),
    r AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS s FROM top UNION ALL SELECT o.doc_id, 1.0 / (60 + row_number() OVER (ORDER BY d.n_chars, o.doc_id)) FROM other o JOIN documents d USING (doc_id))
    SELECT doc_id, round(sum(s)::DOUBLE, 6) AS fused FROM r GROUP BY 1""")
def rrf_fuse(c):
    short = c.table("documents").where(F.contains(F.lower("text"), F.lit("license"))).orderBy("n_chars", "doc_id").limit(50)
    sides = [T.bm25_text(c.table("documents"), "doc_id", "text", _TERMS, 50), short.select("doc_id", (-F.col("n_chars")).cast("double").alias("score"))]
    return T.fuse(sides, "doc_id").select("doc_id", F.round("fused", 6).alias("fused"))


@query("postings_df", "", "WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1")
def postings_df(c):
    return T.document_frequencies(_tokens(c), "tokens")


@query("postings", "", "WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS token FROM documents) SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2")
def postings(c):
    """The inverted index of all documents."""
    return T.postings(_tokens(c), "doc_id", "tokens")


_ASKED = [["theand", "tionre"], ["license", "apache"], ["the"]]
_WORDS = ", ".join(f"({q}, '{w}')" for q, words in enumerate(_ASKED) for w in words)


@query("block_index_search", "", f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS toks FROM documents),
    s AS (SELECT count(*) AS n, avg(len(toks)) AS avg FROM t), q(question, term) AS (VALUES {_WORDS}),
    tf AS (SELECT doc_id, question, term, len(toks) AS len, len(list_filter(toks, lambda x: x = term)) AS tf FROM t, q), df AS (SELECT question, term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1, 2),
    sc AS (SELECT doc_id, question, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 5) AS score FROM tf JOIN df USING (question, term), s GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rn FROM sc WHERE score > 0) SELECT question, doc_id, score FROM r WHERE rn <= 20""")
def block_index_search(c, questions=tuple(map(tuple, _ASKED)), k: int = 20):
    """One index of all documents answers several questions, each from the blocks that can matter."""
    from functools import reduce

    from sonaria.operators import blocks as K

    index = K.build(c.table("documents"), "doc_id", "text", T.latin_words)
    answers = [K.search(c.spark, index, list(words), k).rows.select(F.lit(q).alias("question"), F.col("key").alias("doc_id"), F.round("score", 5).alias("score")) for q, words in enumerate(questions)]
    return reduce(lambda a, b: a.unionByName(b), answers)


@query("tokenize")
def tokenize(c):
    return c.table("documents").select("doc_id", F.size(T.tokenize("text")).alias("n_tokens"))


@query("paginate_text")
def paginate_text(c):
    return c.table("documents").select("doc_id", F.posexplode(T.paginate("text")).alias("page", "text")).select("doc_id", "page", F.char_length("text").alias("n"))


@query("chunk_text")
def chunk_text(c):
    return T.chunk_table(c.table("documents"), "doc_id", "text").select("doc_id", "part", F.char_length("text").alias("n"))


@query("hash_embed_512")
def hash_embed(c):
    """The vector of every whole text, and its squared length: 1, or 0 of a text without tokens."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return T.embed(c.table("documents"), "doc_id", "text").select("doc_id", F.round(norm, 3).alias("norm"), "embedding")


def _chunks(c):
    """chunk_id, text: the chunks of all documents."""
    return T.chunk_table(c.table("documents"), "doc_id", "text").select((F.col("doc_id") * 1_000_000 + F.col("part")).alias("chunk_id"), "text")


@query("vector_recall")
def vector_recall(c, question: str = "licensed under the apache license"):
    near = T.likeness(_chunks(c), "chunk_id", "text", question).orderBy(F.desc("similarity"), "chunk_id").limit(T.RECALL)
    return near.where(F.col("similarity") > T.COSINE_FLOOR).select("chunk_id", F.round("similarity", 5).alias("similarity"))


@query("hybrid_search")
def hybrid_search(c, question: str = "general public license version", k: int = 8):
    return T.hybrid(_chunks(c), "chunk_id", "text", question, k)


@query("mmr_select")
def mmr_select(c, k: int = 6):
    """The neighbours of a seed that the recall finds among all vectors, diversified."""
    from sonaria.operators.vectors import nearest

    seed = c.table("embeddings").where("vec_id = 7").select("embedding").first()
    near = nearest(c.table("embeddings"), list(seed["embedding"]), T.RECALL, without=7)
    return T.diversify(near.select("vec_id", "similarity", F.col("embedding").alias("vec")), "vec_id", "similarity", "vec", k)


@query("merge_kbs", "", f"WITH {BASES}, c AS (SELECT doc_id, page, line, unnest(range(0, (length(line) - 1) // 900 + 1)) AS k FROM lines) SELECT row_number() OVER (ORDER BY doc_id, page, k) AS id, doc_id AS library_id, page, concat('[', source, '] ', substring(line, k * 900 + 1, 900)) AS text FROM c JOIN (SELECT doc_id, source FROM documents) USING (doc_id)")
def merge_kbs(c):
    """The chunks of all bases as one's."""
    return merged_chunks(knowledge_bases(c))


@query("merge_kbs_totals", "", f"WITH {BASES} SELECT (SELECT count(*) FROM documents) AS libraries, count(*) AS page_count, CAST(sum(length(line)) AS BIGINT) AS total_chars, CAST(sum((length(line) - 1) // 900 + 1) AS BIGINT) AS chunks, count(DISTINCT doc_id) AS overviews FROM lines")
def merge_kbs_totals(c):
    return merged_totals(knowledge_bases(c))


@query("merge_kbs_overview", "", f"WITH {BASES} SELECT doc_id AS library_id, concat('[', any_value(source), '] ', arg_min(line, page)) AS text FROM lines GROUP BY 1")
def merge_kbs_overview(c):
    return merged_overview(knowledge_bases(c))


@query("parse_prefix", "manuals", "SELECT id, CAST(library_id AS VARCHAR) AS library FROM manuals")
def parse_prefix(c):
    title = F.concat(F.lit("["), F.col("library_id").cast("string"), F.lit("] "), F.col("name"))
    return c("manuals").select("id", F.regexp_extract(title, r"^\[([^\]]*)\]", 1).alias("library"))


_MEM_WORDS = ["the", "that", "apache"]
_HITS = " + ".join(f"CASE WHEN contains(lower(content), '{w}') THEN 1 ELSE 0 END" for w in _MEM_WORDS)


@query("memory_search", "memory", f"WITH s AS (SELECT id, {_HITS} AS hits, importance, library_id FROM memory) SELECT id, CAST(10 * hits + importance + CASE WHEN library_id = 3 THEN 5 ELSE 0 END AS BIGINT) AS score FROM s WHERE hits > 0 ORDER BY score DESC, id LIMIT 8")
def memory_search(c, words=tuple(_MEM_WORDS), library: int = 3):
    hits = F.size(F.filter(F.array(*[F.lit(w) for w in words if len(w) >= 2]), lambda w: F.contains(F.lower(F.col("content")), w)))
    rows = c("memory").withColumn("hits", hits).where("hits > 0")
    score = 10 * F.col("hits") + F.col("importance") + F.when(F.col("library_id") == library, 5).otherwise(0)
    return rows.select("id", score.cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(8)


@query("memory_budget_block", "memory", """WITH o AS (SELECT id, sum(length(content)) OVER (ORDER BY CASE WHEN library_id = 3 THEN 0 ELSE 1 END, importance DESC, updated_at DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM memory)
    SELECT id FROM o WHERE used <= 20000""")
def memory_budget_block(c, budget: int = 20_000):
    """Memories in order of fit until the first that would overflow.

    Of rows without text as many fit as there are; of the others, each at least a character long, at
    most ``budget``, so these alone are put in order to find the row where the budget ends.
    """
    order = [F.when(F.col("library_id") == 3, 0).otherwise(1), F.desc("importance"), F.desc("updated_at"), F.asc("id")]
    place = F.struct(order[0].alias("a"), (-F.col("importance")).alias("b"), (-F.col("updated_at")).alias("c"), F.col("id").alias("d"))
    rows = c("memory").select("*", F.coalesce(F.char_length("content"), F.lit(0)).alias("size"), place.alias("place"))
    first = rows.where("size > 0").orderBy("place").limit(budget + 1)
    used = F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))  # ``budget`` rows
    end = first.select("place", used.alias("used")).where(F.col("used") > budget).agg(F.min("place").alias("end"))
    return rows.crossJoin(end).where("end is null or place < end").select("id")  # one row


@query("memory_upsert", "memory", "SELECT scope, key, library_id, max_by(id, updated_at) AS id, least(5, greatest(1, max_by(importance, updated_at))) AS importance FROM memory GROUP BY 1, 2, 3")
def memory_upsert(c):
    """The newest row of each scope, key and library."""
    newest = F.max(F.struct("updated_at", "id", "importance")).alias("m")
    rows = c("memory").groupBy("scope", "key", F.coalesce("library_id", F.lit(0)).alias("library_id")).agg(newest)
    return rows.select("scope", "key", "library_id", "m.id", F.least(F.lit(5), F.greatest(F.lit(1), F.col("m.importance"))).alias("importance"))


@query("symbol_search", "trace", "WITH s AS (SELECT DISTINCT tool_name AS name FROM trace) SELECT name FROM s WHERE contains(name, 'i') ORDER BY CASE WHEN starts_with(name, 'i') THEN 0 ELSE 1 END, name LIMIT 40")
def symbol_search(c):
    names = c("trace").select(F.col("tool_name").alias("name")).distinct().where(F.contains("name", F.lit("i")))
    return names.orderBy(F.when(F.startswith("name", F.lit("i")), 0).otherwise(1), "name").limit(40)


_SIZE = "CASE WHEN coalesce(content, '') = '' THEN 8 ELSE floor(length(content) / 4) + 9 END"


@query("compress_history", "messages", f"""WITH t AS (SELECT session_id, id, role, {_SIZE} AS tokens, role = 'assistant' AND length(content) > 60 AS long FROM messages),
    u AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) AS used, sum(CASE WHEN long THEN tokens - 11 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS freed, CASE WHEN long THEN tokens - 11 ELSE 0 END AS own,
    sum(CASE WHEN long THEN tokens - 11 ELSE 0 END) OVER (PARTITION BY session_id) AS most, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n FROM t)
    SELECT session_id, id, CASE WHEN used > 250 AND used - most > 250 AND n > 7 AND back > 6 THEN 'summarised' WHEN used > 250 AND long AND used - (freed - own) > 250 THEN 'blanked' ELSE 'whole' END AS state,
    CAST(CASE WHEN used > 250 AND used - most > 250 AND n > 7 AND back > 6 THEN 0 WHEN used > 250 AND long AND used - (freed - own) > 250 THEN 11 ELSE tokens END AS BIGINT) AS tokens FROM u""")
def compress_history(c, trigger: int = 250):
    """The assistant's longer turns stand in for tool results, which these conversations lack."""
    rows = c("messages").withColumn("long", (F.col("role") == "assistant") & (F.char_length("content") > 60))
    return T.compress_history(rows, trigger, F.col("long"))
