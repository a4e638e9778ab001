"""The reference operators as named queries over the driver's tables, with DuckDB SQL.

The tables hold no reports, so report-shaped rows are derived from what there is: texts
become passages, events become readings, conversations become answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportmill.functions import text as T
from reportmill.functions import values as V
from reportmill.operators import assess as A
from reportmill.operators import chunking, dense_index, grounding, lab_tables, layout, lexical_index, retrieval, search, series_table, serving
from reportmill.operators import evaluation as E
from reportmill.shared import new_folder
from reportmill.sources import stores

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


ASKED = [
    (1, "ering thand tion ering"),
    (2, "Overall, what was found: eaea hener?"),
    (3, "Which medications? mente para que"),
    (4, "what should I do next: und das sch"),
]
HEADINGS = ["IMPRESSION", "Plan", "History", "Medications", "Findings", "Comments"]
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tokens(column: str) -> str:
    return rf"""list_transform(list_filter(regexp_extract_all(lower({column}), '\d+(?:\.\d+)?|[a-z]+'),
      lambda x: len(x) >= 2 AND x NOT IN ({_STOPS})),
      lambda x: CASE WHEN regexp_matches(x, '^\d') OR len(x) <= 3 OR regexp_matches(x, '(ss|us|is|as)$') THEN x ELSE regexp_replace(x, 's$', '') END)"""


_ASKED = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") AS asked(query_id, query)"


def _bm25(scope: str = "", ids: str = "1, 2, 3, 4") -> str:
    """CTEs up to ``hits`` (query_id, scope, doc_id, score, rank)."""
    s, on = (f"{scope}, ", f"AND tf.{scope} IS NOT DISTINCT FROM {{}}.{scope}") if scope else ("", "")
    return f"""
    tok AS (SELECT {s}doc_id, {_tokens("text")} AS terms FROM documents),
    totals AS (SELECT {s}count(*) AS n, avg(len(terms)) AS mean FROM tok {"GROUP BY " + scope if scope else ""}),
    wanted AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({_tokens("query")}) AS term FROM {_ASKED}) WHERE query_id IN ({ids}) GROUP BY ALL),
    tf AS (SELECT {s}doc_id, len, term, count(*) AS tf FROM (SELECT {s}doc_id, len(terms) AS len, unnest(terms) AS term FROM tok) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
    df AS (SELECT {s}term, count(*) AS df FROM tf GROUP BY ALL),
    part AS (SELECT {"tf." + scope + ", " if scope else ""}doc_id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS s
      FROM tf JOIN df ON tf.term = df.term {on.format("df")} JOIN totals ON true {on.format("totals")}),
    scored AS (SELECT query_id, {s}doc_id, round(sum(s * weight), 9) AS score FROM part JOIN wanted USING (term) GROUP BY ALL HAVING round(sum(s * weight), 9) > 0),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id{", " + scope if scope else ""} ORDER BY score DESC, doc_id) AS rank FROM scored)"""


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY term")
def term_stats(spark, sf_dir):
    return retrieval.term_stats(read(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {_bm25()} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM hits WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    hits = retrieval.bm25(read(spark, sf_dir, "documents").select("doc_id", "text"), asked(spark), "doc_id", 10)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25('source')} SELECT query_id, source, doc_id, round(score, 6) AS score, rank FROM hits WHERE rank <= 3")
def bm25_per_source(spark, sf_dir):
    hits = retrieval.bm25(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), asked(spark), "doc_id", 3, ["source"])
    return hits.select("query_id", "source", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _indexed(spark, sf_dir, scope=()) -> lexical_index.LexicalIndex:
    """The documents in a new stored index, in two batches, the second of which holds what the first does not."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    index = lexical_index.LexicalIndex(spark, new_folder(spark, "lexical"), "doc_id", scope)
    index.add(docs.filter("lang = 'en'"), "English")
    index.add(index.absent(docs), "others")
    return index


@query(ORACLES["bm25_topk"])
def bm25_stored(spark, sf_dir):
    hits = _indexed(spark, sf_dir).search(asked(spark), 10)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(ORACLES["bm25_per_source"])
def bm25_stored_per_source(spark, sf_dir):
    hits = _indexed(spark, sf_dir, ["source"]).search(asked(spark), 3)
    return hits.select("query_id", "source", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings)
SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def cosine_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    wanted = vectors.filter("vec_id = 0").select(F.lit(1).alias("query_id"), "vector")
    hits = retrieval.dense(vectors, wanted, "vec_id", 10)
    return hits.select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _vector_index(spark, sf_dir) -> tuple[dense_index.DenseIndex, DataFrame]:
    vectors = read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    index = dense_index.DenseIndex(spark, new_folder(spark, "vectors"), "vec_id")
    index.upsert(vectors)
    return index, vectors


@query(ORACLES["cosine_topk"])
def cosine_stored(spark, sf_dir):
    index, vectors = _vector_index(spark, sf_dir)
    hits = index.search(vectors.filter("vec_id = 0").select(F.lit(1).alias("query_id"), "vector"), 10)
    return hits.select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def knn_stored(spark, sf_dir):
    """Every row whose id is divisible by 50 against all rows."""
    index, vectors = _vector_index(spark, sf_dir)
    hits = index.search(vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), 10)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_KNN = """s AS (SELECT q.vec_id AS query_id, e.vec_id, q.label AS want, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5),
  f AS (SELECT query_id, want, min(CASE WHEN label = want THEN rank END) AS first_rank FROM r GROUP BY ALL)"""
_SCORES = """count(*) AS questions, round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3,
  round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 / first_rank ELSE 0.0 END), 6) AS mrr"""


def _knn_first(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    wanted = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    hits = retrieval.dense(vectors, wanted, "vec_id", 6).filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").join(vectors.select("vec_id", "label"), "vec_id")
    wants = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    judged = hits.join(wants, "query_id").withColumn("relevant", F.col("label") == F.col("want"))
    return E.first_relevant(judged, ["query_id", "want"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_KNN} SELECT {_SCORES} FROM f")
def knn_label_eval(spark, sf_dir):
    return _rounded(E.retrieval_scores(_knn_first(spark, sf_dir), [[]]))


@query(f"WITH {_KNN} SELECT coalesce(want, -1)::BIGINT AS want, {_SCORES} FROM f GROUP BY GROUPING SETS ((want), ())")
def retrieval_metrics(spark, sf_dir):
    scores = _rounded(E.retrieval_scores(_knn_first(spark, sf_dir), [["want"], []]))
    return scores.withColumn("want", F.coalesce("want", F.lit(-1)).cast("long"))


@query(f"""WITH {_bm25(ids="1")}, a AS (SELECT doc_id, rank FROM hits WHERE rank <= 50),
 b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
 fused AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused QUALIFY rank <= 20""")
def rrf_fusion(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    a = retrieval.bm25(docs.select("doc_id", "text"), asked(spark).filter("query_id = 1"), "doc_id", 50)
    longest = docs.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    b = longest.select(F.lit(1).alias("query_id"), "doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return retrieval.fuse([a, b], "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _with_headings(docs: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, HEADINGS))
    return docs.withColumn("headings", F.array(F.element_at(names, (F.col("doc_id") % len(HEADINGS) + 1).cast("int"))))


_INTENT_SQL = "(VALUES " + ", ".join("('" + q.replace("'", "''") + "', '" + s.replace("'", "''") + "')" for q, s in retrieval.INTENTS) + ") AS i(question, section)"
_HEADED = "(SELECT *, ([" + ", ".join(f"'{h}'" for h in HEADINGS) + f"])[doc_id % {len(HEADINGS)} + 1] AS heading FROM documents)"
_ROUTED = f"routed AS (SELECT DISTINCT query_id, doc_id FROM {_ASKED} JOIN {_INTENT_SQL} ON regexp_matches(query, question) JOIN {_HEADED} d ON regexp_matches(heading, section))"


@query(f"WITH {_ROUTED} SELECT query_id, doc_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM routed QUALIFY rank <= 5")
def section_route(spark, sf_dir):
    docs = _with_headings(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("ix", F.col("doc_id"))
    hits = retrieval.route_sections(docs, asked(spark), "doc_id", "ix")
    return hits.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_bm25().replace('lower(text)', "lower(heading || chr(10) || text)").replace('FROM documents', f'FROM {_HEADED}')}, {_ROUTED},
 r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM routed QUALIFY rank <= 10),
 fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM hits WHERE rank <= 10 UNION ALL SELECT * FROM r) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 5""")
def hybrid_search(spark, sf_dir):
    docs = _with_headings(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("ix", F.col("doc_id"))
    strategies = [
        lambda q, k: retrieval.bm25(docs, q, "doc_id", k),
        lambda q, k: retrieval.route_sections(docs, q, "doc_id", "ix", k),
    ]
    hits = retrieval.hybrid(asked(spark), strategies, "doc_id")
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_bm25().replace('lower(text)', "lower(heading || chr(10) || text)").replace('FROM documents', f'FROM {_HEADED}')}, {_ROUTED},
 r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM routed QUALIFY rank <= 10),
 c AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings e ON true
  WHERE q.vec_id IN (SELECT query_id FROM {_ASKED}) AND e.vec_id IN (SELECT doc_id FROM documents)),
 d AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c QUALIFY rank <= 10),
 fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM hits WHERE rank <= 10 UNION ALL SELECT * FROM r UNION ALL SELECT * FROM d) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused QUALIFY rank <= 5""")
def three_leg_search(spark, sf_dir):
    """Lexical, section and dense legs over stored indexes, made if absent; the vector of a document or question is the one with its id."""
    docs = _with_headings(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("ix", F.col("doc_id"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    words = lexical_index.LexicalIndex(spark, new_folder(spark, "lexical"), "doc_id")
    dense = dense_index.DenseIndex(spark, new_folder(spark, "vectors"), "doc_id")
    search.ensure_lexical(words, docs, "documents")
    search.ensure_dense(dense, docs.select("doc_id"), lambda new: new.join(vectors, "doc_id"))
    own = vectors.withColumnRenamed("doc_id", "query_id")
    legs = search.legs(docs, "doc_id", "ix", words, dense, lambda q: q.join(own, "query_id", "left"))
    hits = retrieval.hybrid(asked(spark), legs, "doc_id")
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


#: Questions' kinds and the phrases that answer them.
ANSWERED = [(1, "lexical", ["ering thand", "tiontion"]), (2, "section", ["impression"]), (3, "section", ["medications"]), (4, "lexical", ["und das"])]
_ANSWERED = "(VALUES " + ", ".join(f"({i}, '{k}', {p})" for i, k, p in ANSWERED) + ") AS answered(query_id, kind, phrases)"


@query(f"""WITH {_bm25().replace('lower(text)', "lower(heading || chr(10) || text)").replace('FROM documents', f'FROM {_HEADED}')}, {_ROUTED},
 r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM routed QUALIFY rank <= 10),
 fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM hits WHERE rank <= 10 UNION ALL SELECT * FROM r) GROUP BY ALL),
 every AS (SELECT 'BM25' AS system, query_id, doc_id, rank FROM hits WHERE rank <= 5
  UNION ALL SELECT 'BM25 + sections', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 5),
 found AS (SELECT system, query_id, min(rank) AS first_rank FROM every JOIN {_HEADED} d USING (doc_id) JOIN {_ANSWERED} USING (query_id)
  WHERE list_bool_or(list_transform(phrases, lambda p: contains(lower(heading || chr(10) || text), p))) GROUP BY ALL),
 f AS (SELECT s.system, kind, first_rank FROM {_ANSWERED} CROSS JOIN (VALUES ('BM25'), ('BM25 + sections')) AS s(system) LEFT JOIN found ON found.system = s.system AND found.query_id = answered.query_id)
SELECT system, coalesce(kind, 'all') AS kind, {_SCORES} FROM f GROUP BY GROUPING SETS ((system, kind), (system))""")
def system_comparison(spark, sf_dir):
    docs = _with_headings(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("ix", F.col("doc_id"))
    lexical = lambda q, k: retrieval.bm25(docs, q, "doc_id", k)
    sections = lambda q, k: retrieval.route_sections(docs, q, "doc_id", "ix", k)
    systems = {"BM25": retrieval.hybrid(asked(spark), [lexical], "doc_id"), "BM25 + sections": retrieval.hybrid(asked(spark), [lexical, sections], "doc_id")}
    questions = spark.createDataFrame(ANSWERED, "query_id int, kind string, relevant array<string>")
    scores = E.compare_systems(systems, questions, docs.select("doc_id", retrieval.passage_text(docs).alias("text")), ["doc_id"])
    return _rounded(scores.withColumn("kind", F.coalesce("kind", F.lit("all"))))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
 m AS (SELECT doc_id, t, len(t) AS n, coalesce(list_min(list_filter(list_transform(['ering', 'thand', 'tion'], lambda w: instr(lower(t), w) - 1), lambda p: p >= 0)), -1) AS a FROM f),
 e AS (SELECT *, least(n, greatest(0, a - 80) + 160) AS e0 FROM m), s AS (SELECT *, greatest(0, e0 - 160) AS s0 FROM e),
 g AS (SELECT *, instr(substr(t, s0 + 1), ' ') AS gap, instr(reverse(substr(t, 1, e0 + 1)), ' ') AS back FROM s),
 h AS (SELECT *, CASE WHEN s0 > 0 AND gap > 0 AND gap - 1 + s0 < a THEN gap + s0 ELSE s0 END AS b FROM g),
 i AS (SELECT *, CASE WHEN e0 < n AND back > 0 AND e0 + 1 - back > b THEN e0 + 1 - back ELSE e0 END AS z FROM h)
SELECT doc_id, CASE WHEN n <= 160 THEN t WHEN a < 0 THEN rtrim(substr(t, 1, 160)) || '…'
 ELSE (CASE WHEN b > 0 THEN '…' ELSE '' END) || trim(substr(t, b + 1, z - b)) || (CASE WHEN z < n THEN '…' ELSE '' END) END AS snippet FROM i""")
def snippets(spark, sf_dir):
    terms = T.tokenize(F.lit("ering thand tion"))
    return T.add_snippet(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", terms).select("doc_id", "snippet")


_LINES = r"""lines AS (SELECT source, doc_id AS page, 0 AS ix, 'Report of ' || source || ', page ' || doc_id AS text FROM documents
  UNION ALL SELECT source, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i), l FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
 y AS (SELECT *, -20.0 * ix AS y, max(-20.0 * ix) OVER (PARTITION BY source, page) AS top, min(-20.0 * ix) OVER (PARTITION BY source, page) AS bottom,
   trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS key FROM lines),
 e AS (SELECT *, key <> '' AND top - bottom >= 100 AND (y >= top - (top - bottom) * 0.15 OR y <= bottom + (top - bottom) * 0.15) AS edge FROM y),
 sizes AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source),
 often AS (SELECT e.source, e.key FROM e JOIN sizes ON e.source = sizes.source WHERE edge GROUP BY e.source, e.key, pages HAVING count(DISTINCT page) >= greatest(2, ceil(pages / 2.0)))"""


def _report_lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    head = F.concat(F.lit("Report of "), "doc_id", F.lit(", page "), F.col("page").cast("string"))
    texts = F.concat(F.array(head), F.split("text", "\n", -1))
    rows = docs.select("doc_id", "page", F.posexplode(texts).alias("line_ix", "text"))
    return rows.withColumn("y", F.col("line_ix") * -20.0), docs.select("doc_id", "page")


@query(f"WITH {_LINES} SELECT source, page, count(*) AS kept FROM e WHERE NOT (edge AND (source, key) IN (SELECT source, key FROM often)) GROUP BY ALL")
def furniture_strip(spark, sf_dir):
    found, pages = _report_lines(spark, sf_dir)
    kept = layout.strip_furniture(found, pages)
    return kept.groupBy(F.col("doc_id").alias("source"), "page").agg(F.count(F.lit(1)).alias("kept"))


@query(f"WITH {_LINES} SELECT key, count(*) AS n FROM y GROUP BY key")
def furniture_keys(spark, sf_dir):
    found, _ = _report_lines(spark, sf_dir)
    return found.groupBy(T.furniture_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT l_returnflag, floor(l_quantity * 2 + 0.5) / 2 AS body, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, body::DOUBLE AS body FROM c QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, body) = 1""")
def mode_bucket(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("doc_id"), F.lit(1).alias("page"), F.col("l_quantity").cast("double").alias("font_size"))
    return layout.body_sizes(rows).select(F.col("doc_id").alias("l_returnflag"), F.col("body").cast("double").alias("body"))


#: Parts of lines and then chunks of parts are folds over ordered lists, each with the last one open.
@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
 b AS (SELECT * FROM l WHERE trim(line, ' ') <> ''),
 s AS (SELECT doc_id, i, unnest(found) AS sentence, generate_subscripts(found, 1) AS j FROM (SELECT doc_id, i, CASE WHEN len(regexp_extract_all(line, '[^.!?]+[.!?]*')) = 0 THEN [line]
   ELSE regexp_extract_all(line, '[^.!?]+[.!?]*') END AS found FROM b WHERE len(line) > 1200)),
 t AS (SELECT doc_id, i, j, regexp_replace(sentence, '^\s+|\s+$', '', 'g') AS sentence FROM s),
 w AS (SELECT doc_id, i, j, 1 AS k, sentence AS piece, false AS fresh FROM t WHERE len(sentence) BETWEEN 1 AND 1200 UNION ALL
  SELECT doc_id, i, j, generate_subscripts(string_split_regex(sentence, '\s+'), 1), unnest(string_split_regex(sentence, '\s+')), generate_subscripts(string_split_regex(sentence, '\s+'), 1) = 1 FROM t WHERE len(sentence) > 1200),
 r AS (SELECT doc_id, i, list_reduce(list_prepend({'parts': []::VARCHAR[], 'piece': '', 'fresh': false}, list({'parts': []::VARCHAR[], 'piece': piece, 'fresh': fresh} ORDER BY j, k)), lambda a, x:
   CASE WHEN len(a.parts) > 0 AND NOT x.fresh AND len(a.parts[-1]) + 1 + len(x.piece) <= 1200
    THEN {'parts': list_append(a.parts[:-2], a.parts[-1] || ' ' || x.piece), 'piece': '', 'fresh': false}
    ELSE {'parts': list_append(a.parts, x.piece), 'piece': '', 'fresh': false} END).parts AS parts FROM w GROUP BY doc_id, i),
 p AS (SELECT doc_id, i, 0 AS j, line AS part FROM b WHERE len(line) <= 1200 UNION ALL SELECT doc_id, i, generate_subscripts(parts, 1), unnest(parts) FROM r),
 q AS (SELECT doc_id, list_reduce(list_prepend({'out': []::VARCHAR[], 'part': ''}, list({'out': []::VARCHAR[], 'part': part} ORDER BY i, j)), lambda a, x:
   CASE WHEN len(a.out) > 0 AND len(a.out[-1]) + 1 + len(x.part) <= 1200 THEN {'out': list_append(a.out[:-2], a.out[-1] || ' ' || x.part), 'part': ''}
    WHEN len(a.out) = 0 THEN {'out': [x.part], 'part': ''}
    ELSE {'out': list_append(a.out, CASE WHEN len(a.out[-1]) <= 160 THEN a.out[-1] WHEN instr(right(a.out[-1], 160), ' ') > 0 THEN substr(right(a.out[-1], 160), instr(right(a.out[-1], 160), ' ') + 1) ELSE right(a.out[-1], 160) END
      || CASE WHEN instr(right(a.out[-1], 160), ' ') = 160 AND len(a.out[-1]) > 160 THEN '' ELSE ' ' END || x.part), 'part': ''} END).out AS texts FROM p GROUP BY doc_id),
 c AS (SELECT doc_id, regexp_replace(unnest(texts), '^\s+|\s+$', '', 'g') AS text, generate_subscripts(texts, 1) AS n FROM q),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS nth FROM c WHERE text <> '')
SELECT doc_id::VARCHAR AS doc_id, 'p1#' || nth AS chunk_id, (nth - 1)::INTEGER AS chunk_ix, sha1(text) AS text_sha1, len(text)::INTEGER AS n_chars, 1 AS page, 1 AS end_page, 'prose' AS kind FROM k""")
def chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = chunking.chunks(chunking.document_blocks(docs))
    return made.select("doc_id", "chunk_id", "chunk_ix", F.sha1(F.col("text").cast("binary")).alias("text_sha1"), F.length("text").alias("n_chars"), "page", "end_page", "kind")


@query("""SELECT p_partkey, p_retailprice::DOUBLE AS value, CASE p_partkey % 4 WHEN 1 THEN '<' WHEN 3 THEN '>=' END AS comparator,
 CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS flag, CASE WHEN p_partkey % 5 < 4 THEN 'mg/dL' END AS unit FROM part""")
def lab_values_parse(spark, sf_dir):
    k = F.col("p_partkey")
    sign = F.when(k % 4 == 1, "<").when(k % 4 == 3, "≥ ").otherwise("")
    flag = F.when(k % 3 == 0, " H").when(k % 3 == 1, " (Low)").otherwise("")
    unit = F.when(k % 5 < 4, " mg/dL").otherwise("")
    text = F.concat(sign, F.col("p_retailprice").cast("decimal(12,2)").cast("string"), unit, flag)
    parsed = read(spark, sf_dir, "part").select("p_partkey", V.parse_value(text).alias("v"))
    return parsed.select("p_partkey", "v.value", "v.comparator", "v.flag", "v.unit")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE p_size::DOUBLE END AS low,
 CASE WHEN p_partkey % 3 = 0 THEN (p_size + 10)::DOUBLE WHEN p_partkey % 3 = 1 THEN p_size::DOUBLE END AS high FROM part""")
def lab_ranges_parse(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    two = F.concat(F.lit("Ref range: ("), size, F.lit(" – "), (F.col("p_size") + 10).cast("string"), F.lit(" mmol/L)"))
    text = F.when(k % 3 == 0, two).when(k % 3 == 1, F.concat(F.lit("up to "), size)).otherwise(F.concat(F.lit("≥"), size, F.lit(" %")))
    found = V.parse_range(F.regexp_replace(text, r"^Ref range: \((.*)\)$", "Ref range: $1"))
    return read(spark, sf_dir, "part").select("p_partkey", found["low"].alias("low"), found["high"].alias("high"))


#: Event types as tests: name, unit.
TESTS = {"click": ("ALT (SGPT)", "IU/L"), "view": ("Serum potassium", "mmol/L"), "error": ("Lactate", "mmol/L"), "purchase": ("CRP", "mg/L"), "login": ("Hb", "g/dL")}
_TESTS = "CASE event_type WHEN 'click' THEN 'alt' WHEN 'view' THEN 'potassium' WHEN 'error' THEN 'lactate' WHEN 'purchase' THEN 'crp' WHEN 'login' THEN 'hemoglobin' END"
_LOW = "CASE event_type WHEN 'click' THEN 4.0 WHEN 'view' THEN 3.5 WHEN 'error' THEN 0.5 WHEN 'login' THEN 11.5 END"
_HIGH = "CASE event_type WHEN 'click' THEN 56.0 WHEN 'view' THEN 5.2 WHEN 'error' THEN 2.2 WHEN 'purchase' THEN 10.0 WHEN 'login' THEN 17.5 END"


def readings(spark, sf_dir) -> DataFrame:
    """Events as results: every third has a printed range, every fifth a flag."""
    ev = read(spark, sf_dir, "events")
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in TESTS.items() for x in (k, v[i])))
    e = F.col("event_id")
    rng = F.struct(F.lit(1.0).alias("low"), F.lit(40.0).alias("high"))
    return ev.select(
        "event_id",
        "ts",
        F.col("user_id").alias("doc_id"),
        F.coalesce(F.try_element_at(pick(0), "event_type"), F.col("event_type")).alias("name"),
        F.try_element_at(pick(1), "event_type").alias("unit"),
        F.col("value").cast("double").alias("value"),
        F.when(e % 4 == 0, "<").when(e % 4 == 1, ">").alias("comparator"),
        F.when(e % 3 == 0, rng).alias("printed_range"),
        F.when(e % 3 == 0, "1-40").alias("printed_range_text"),
        F.when(e % 5 == 0, "high").when(e % 5 == 1, "abnormal").alias("printed_flag"),
        (e % 3 + 1).cast("int").alias("page"),
        F.lit("table").alias("source"),
    )


_ASSESSED = f"""r AS (SELECT event_id, ts, user_id, event_type, value::DOUBLE AS value, {_TESTS} AS analyte, {_LOW} AS tl, {_HIGH} AS th, event_id % 3 = 0 AS printed,
   CASE event_id % 4 WHEN 0 THEN '<' WHEN 1 THEN '>' END AS cmp, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'abnormal' END AS flag FROM events),
 p AS (SELECT *, printed AND coalesce(NOT (1.0 > tl * 3 OR 1.0 < tl / 3), true) AND coalesce(NOT (40.0 > th * 3 OR 40.0 < th / 3), true) AS used FROM r),
 q AS (SELECT *, CASE WHEN used THEN 1.0 ELSE tl END AS lo, CASE WHEN used THEN 40.0 ELSE th END AS hi, CASE WHEN used THEN 'report' WHEN analyte IS NOT NULL THEN 'typical' END AS basis FROM p),
 c AS (SELECT *, CASE WHEN basis IS NULL THEN 'unknown' WHEN cmp IS NULL THEN CASE WHEN value < lo THEN 'low' WHEN value > hi THEN 'high' ELSE 'normal' END
   WHEN cmp = '<' THEN CASE WHEN lo IS NOT NULL THEN CASE WHEN value <= lo THEN 'low' ELSE 'unknown' END WHEN hi IS NOT NULL AND value <= hi THEN 'normal' ELSE 'unknown' END
   ELSE CASE WHEN hi IS NOT NULL THEN CASE WHEN value >= hi THEN 'high' ELSE 'unknown' END WHEN lo IS NOT NULL AND value >= lo THEN 'normal' ELSE 'unknown' END END AS computed FROM q),
 a AS (SELECT *, CASE WHEN flag IS NULL THEN computed WHEN flag = 'high' THEN 'high' WHEN computed IN ('low', 'high') THEN computed ELSE 'abnormal' END AS status FROM c)"""


@query(f"""WITH {_ASSESSED} SELECT event_id, analyte, status, lo::DOUBLE AS range_low, hi::DOUBLE AS range_high, basis,
 coalesce(flag = 'high' AND basis = 'report' AND computed <> 'unknown' AND computed <> 'high', false) AS conflict, CASE WHEN printed AND NOT used THEN '1-40' END AS doubtful_range FROM a""")
def lab_assess(spark, sf_dir):
    done = A.assess(readings(spark, sf_dir))
    return done.select("event_id", "analyte", "status", "range_low", "range_high", "basis", "conflict", "doubtful_range")


def _assessed(spark, sf_dir) -> DataFrame:
    return A.assess(readings(spark, sf_dir)).withColumn("test", A.test_key(F.col("name"), F.col("unit"), F.col("analyte")))


def _series(results: DataFrame) -> DataFrame:
    return series_table.finished(series_table.summarize(results, ["doc_id"], "event_id", F.to_date("ts"), ["value", "status"]), ["doc_id"])


_TEST = "coalesce(analyte, lower(event_type) || '|')"


@query(f"""WITH {_ASSESSED}, s AS (SELECT user_id AS doc_id, {_TEST} AS test, count(*) AS n, min(event_id) AS first_ix, first(value ORDER BY ts::DATE, event_id) AS earliest,
  last(value ORDER BY ts::DATE, event_id) AS latest, last(status ORDER BY ts::DATE, event_id) AS latest_status FROM a GROUP BY ALL)
SELECT doc_id, test, n, latest, latest_status, latest_status IN ('low', 'high', 'abnormal') AS out_of_range, CASE WHEN n >= 2 THEN CASE WHEN latest < earliest THEN 'down' ELSE 'up' END END AS trend,
 row_number() OVER (PARTITION BY doc_id ORDER BY latest_status IN ('low', 'high', 'abnormal') DESC, first_ix) AS position FROM s""")
def lab_series(spark, sf_dir):
    found = A.flagged_first(_series(_assessed(spark, sf_dir)), ["doc_id"])
    return found.select("doc_id", "test", F.col("n").cast("long").alias("n"), F.col("latest.value").alias("latest"), F.col("latest.status").alias("latest_status"), "out_of_range", "trend", F.col("position").cast("long").alias("position"))


@query(f"""WITH {_ASSESSED}, s AS (SELECT user_id AS doc_id, {_TEST} AS test, last(status ORDER BY ts::DATE, event_id) AS latest_status, list_sort(list_distinct(list(event_id % 3 + 1))) AS pages FROM a GROUP BY ALL)
SELECT doc_id, count(*) FILTER (latest_status IN ('low', 'high', 'abnormal')) AS flagged, count(*) AS total, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages FROM s GROUP BY doc_id""")
def lab_headline(spark, sf_dir):
    results = _assessed(spark, sf_dir)
    return series_table.headline(_series(results), results, ["doc_id"]).select("doc_id", "flagged", "total", F.array_join("pages", ",").alias("pages"))


@query(ORACLES["lab_headline"])
def lab_headline_by_batches(spark, sf_dir):
    """The same from a stored table of figures, which took the results in two batches and one of these twice."""
    results, table = _assessed(spark, sf_dir), series_table.SeriesTable(spark, new_folder(spark, "series"), ["doc_id"])
    batches = {"early": results.filter("event_id % 3 = 1"), "late": results.filter("event_id % 3 <> 1")}
    for name in ("early", "late", "early"):
        table.add(batches[name], name, "event_id", F.to_date("ts"), ["value", "status"])
    return table.headline().select("doc_id", "flagged", "total", F.array_join("pages", ",").alias("pages"))


@query(r"""WITH t AS (SELECT DISTINCT l.term_id, l.term FROM (SELECT doc_id AS term_id, lower(trim(regexp_replace(left(text, 12), '\s+', ' ', 'g'))) AS term FROM documents) l),
 d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM documents),
 m AS (SELECT term_id, doc_id FROM t JOIN d ON contains(d.text, t.term))
SELECT term_id, doc_id, row_number() OVER (PARTITION BY term_id ORDER BY doc_id) AS rank FROM m QUALIFY rank <= 4""")
def passages_for_terms(spark, sf_dir):
    """The first words of every document, as selected terms, against all documents; without search hits."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    terms = docs.select(F.col("doc_id").alias("term_id"), F.left("text", F.lit(12)).alias("term"))
    none = terms.limit(0).select("term_id", F.col("term_id").alias("doc_id"), F.lit(0).alias("rank"))
    found = retrieval.passages_for_terms(docs, none, terms, "doc_id", "doc_id")
    return found.select("term_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH r AS (SELECT event_id, user_id AS doc_id, event_id % 3 + 1 AS page, {_TEST.replace("analyte", _TESTS)} AS test, round(value) AS value FROM events),
 old AS (SELECT * FROM r WHERE event_id % 2 = 0), new AS (SELECT * FROM r WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY doc_id, page, test, value ORDER BY event_id) = 1)
SELECT event_id, 0 AS part FROM old UNION ALL SELECT event_id, 1 FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.doc_id = new.doc_id AND old.page = new.page AND old.test = new.test AND old.value = new.value)""")
def lab_merge(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("value", F.round("value")).withColumn("row_ix", F.col("event_id"))
    merged = A.merge(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["doc_id"])
    return merged.select("event_id", "part")


@query("""WITH g AS (SELECT event_id, value::DOUBLE AS v, CASE WHEN event_id % 3 <> 1 THEN 5.0 END AS lo, CASE WHEN event_id % 3 <> 2 THEN 20.0 END AS hi FROM events),
 m AS (SELECT *, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (v - lo) / (hi - lo) WHEN hi IS NOT NULL THEN v / hi ELSE v / lo END AS d FROM g)
SELECT event_id, round(CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN d < 0 THEN 0.3 - 0.26 * (1 - 1 / (1 - 2 * d)) WHEN d > 1 THEN 0.7 + 0.26 * (1 - 1 / (1 + 2 * (d - 1))) ELSE 0.3 + d * 0.4 END
 WHEN hi IS NOT NULL THEN CASE WHEN d > 1 THEN 0.7 + 0.26 * (1 - 1 / (1 + 2 * (d - 1))) ELSE greatest(0.04, d * 0.7) END
 ELSE CASE WHEN d < 1 THEN greatest(0.04, d * 0.3) ELSE 0.3 + 0.66 * (1 - 1 / (1 + 2 * (d - 1))) END END, 6)::DOUBLE AS marker FROM m""")
def gauge(spark, sf_dir):
    e = F.col("event_id")
    low, high = F.when(e % 3 != 1, 5.0), F.when(e % 3 != 2, 20.0)
    return read(spark, sf_dir, "events").select("event_id", F.round(V.gauge(F.col("value").cast("double"), low, high)["marker"], 6).alias("marker"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, true AS date_like FROM orders""")
def date_parse(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    printed = (
        F.when(k % 5 == 0, F.date_format(d, "dd - MMM - yyyy"))
        .when(k % 5 == 1, F.concat(F.date_format(d, "d-MMM-yyyy"), F.lit(" 09:30")))
        .when(k % 5 == 2, F.date_format(d, "MMM d, yyyy"))
        .when(k % 5 == 3, F.date_format(d, "yyyy-MM-dd"))
        .otherwise(F.date_format(d, "dd/MM/yyyy"))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", V.parse_date(printed).cast("string").alias("day"), V.is_date_like(printed).alias("date_like"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_ix, round(o_totalprice)::BIGINT AS v FROM orders)
SELECT o_custkey::VARCHAR AS doc_id, row_ix::INTEGER AS row_ix, 'Sodium' AS name, (v % 1000 + i)::DOUBLE AS value, 'mmol/L' AS unit, CASE i WHEN 0 THEN '12-Mar-2026' ELSE '19-Mar-2026' END AS date FROM r, (VALUES (0), (1)) AS x(i)""")
def unpivot_dates(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    v = F.round("o_totalprice").cast("long") % 1000
    row = F.array(F.lit("Sodium"), v.cast("string"), (v + 1).cast("string"), F.lit("mmol/L"))
    rows = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("found"))
    head = F.array(F.array(*map(F.lit, ("Test", "12-Mar-2026", "19-Mar-2026", "Units"))))
    table = F.concat(head, F.transform("found", lambda x: x["row"]))
    blocks = rows.select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("block_ix"), F.lit("table").alias("kind"), table.alias("rows"))
    return lab_tables.read_tables(blocks).select("doc_id", "row_ix", "name", "value", "unit", "date")


@query(r"""WITH n AS (SELECT doc_id, text, regexp_extract(text, '(?:^|[^0-9.])([1-9]\d{0,2})(?:$|[^0-9.,])', 1) AS num, regexp_extract(lower(text), '[a-z]{4,}', 0) AS word FROM documents)
SELECT doc_id, true AS kept, 'as printed' AS form FROM n WHERE num <> '' AND word <> '' UNION ALL
SELECT doc_id, false, 'foreign name' FROM n WHERE num <> '' AND word <> ''""")
def grounding_check(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    num = F.regexp_extract("text", r"(?:^|[^0-9.])([1-9][0-9]{0,2})(?:\z|[^0-9.,])", 1)
    word = F.regexp_extract(F.lower("text"), "[a-z]{4,}", 0)
    base = docs.select("doc_id", num.alias("num"), word.alias("word")).filter("num <> '' and word <> ''")
    forms = F.array(F.struct(F.lit("as printed").alias("form"), F.col("word").alias("name")), F.struct(F.lit("foreign name").alias("form"), F.lit("Zzyzx ferritin").alias("name")))
    rows = base.select("doc_id", "num", F.posexplode(forms).alias("i", "f"))
    none = F.lit(None).cast("string")
    rows = rows.select("doc_id", F.lit(1).alias("page"), "f.name", F.col("num").alias("value"), none.alias("unit"), none.alias("reference_range"), none.alias("flag"), none.alias("date"), "f.form")
    passages = docs.select("doc_id", F.lit(0).alias("chunk_ix"), "text", F.lit(1).alias("page"), F.lit(1).alias("end_page"))
    done = grounding.ground(rows.drop("form"), passages)
    return done.select("doc_id", "kept", F.when(F.col("name") == "Zzyzx ferritin", "foreign name").otherwise("as printed").alias("form"))


def _read_parts(spark, sf_dir) -> DataFrame:
    """Parts as pages with one result each, read by a model that changes some values, ranges, units and dates."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    k, low, high = F.col("p_partkey"), F.col("p_size").cast("string"), (F.col("p_size") + 10).cast("string")
    day = F.concat(F.lit("2024-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    page = F.concat(F.lit("Serum Ferritin (fasting) "), F.col("price").cast("string"), F.lit(" mg/dL, range "), low, F.lit(" - "), high, F.lit(", taken "), day)
    passages = parts.select(F.lit(0).alias("chunk_ix"), k.alias("doc_id"), page.alias("text"), F.lit(3).alias("page"), F.lit(4).alias("end_page"))
    rows = parts.select(
        k.alias("doc_id"),
        F.when(k % 6 == 5, 5).otherwise(3 + (k % 2).cast("int")).alias("page"),
        F.lit("Serum ferritin").alias("name"),
        F.when(k % 5 == 0, F.col("price") + 1).otherwise(F.col("price")).cast("string").alias("value"),
        F.when(k % 2 == 0, "mg/dL").otherwise("as told by the laboratory").alias("unit"),
        F.when(k % 3 == 0, "7000 - 8000").otherwise(F.concat(low, F.lit(" - "), high)).alias("reference_range"),
        F.when(k % 7 == 0, "H").when(k % 7 == 1, "L").alias("flag"),
        F.when(k % 4 == 0, "2031-01-01").otherwise(day).alias("date"),
    )
    return grounding.ground(rows, passages)


_GROUNDED = """SELECT p_partkey AS doc_id, p_partkey % 5 <> 0 AND p_partkey % 6 <> 5 AS kept, CASE WHEN p_partkey % 2 = 0 THEN 'mg/dL' END AS unit,
 CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 6 <> 5 THEN '2024-03-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') END AS date,
 CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 6 <> 5 THEN p_size::DOUBLE END AS low, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 6 <> 5 THEN (p_size + 10)::DOUBLE END AS high,
 CASE p_partkey % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS flag FROM part"""


@query(_GROUNDED)
def grounding_parts(spark, sf_dir):
    """Ranges, units, dates and flags of rows that a page supports in part; pages 3 and 4 share a passage, page 5 has none."""
    done = _read_parts(spark, sf_dir)
    return done.select("doc_id", "kept", "unit", "date", F.col("printed_range.low").alias("low"), F.col("printed_range.high").alias("high"), F.col("printed_flag").alias("flag"))


@query(f"SELECT doc_id % 10 AS batch, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS discarded FROM ({_GROUNDED}) GROUP BY batch")
def grounding_batches(spark, sf_dir):
    return grounding.kept_and_discarded(_read_parts(spark, sf_dir).withColumn("batch", F.col("doc_id") % 10), ["batch"])


@query("""WITH a AS (SELECT o_orderpriority AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'O'),
 b AS (SELECT o_orderpriority AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'F'),
 m AS (SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS correct, count(*) FILTER (b.k IS NULL) AS extra, count(*) FILTER (a.k IS NULL) AS missed FROM a FULL JOIN b ON a.k = b.k AND a.nth = b.nth)
SELECT correct, extra, missed, round(correct / (correct + extra), 6) AS precision, round(correct / (correct + missed), 6) AS recall, round(2.0 * correct / (2 * correct + extra + missed), 6)::DOUBLE AS f1 FROM m""")
def multiset_match(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), "o_orderstatus")
    matched = E.multiset_match(orders.filter("o_orderstatus = 'O'"), orders.filter("o_orderstatus = 'F'"), ["k"])
    return _rounded(E.match_counts(matched))


@query("""WITH r AS (SELECT conv_id, turn, sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations)
SELECT conv_id, turn, used::BIGINT AS used FROM r WHERE used <= 1500 OR turn = 0""")
def budget_pack(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("rank", F.col("turn") + 1)
    return retrieval.pack(turns, ["conv_id"], budget=1500).select("conv_id", "turn", "used")


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN turn::VARCHAR ELSE turn || ',' || (turn + 3) END AS pages FROM conversations")
def citations(spark, sf_dir):
    t = F.col("turn").cast("string")
    marks = F.when(F.col("turn") % 3 == 0, " [p.0]").when(F.col("turn") % 3 == 1, F.concat(F.lit(" [P. "), t, F.lit("-99]")))
    marks = marks.otherwise(F.concat(F.lit(" [p."), t, F.lit("] and [p."), (F.col("turn") + 3).cast("string"), F.lit("]")))
    text = F.concat("text", marks)
    pages = F.array_join(F.transform(T.cited_pages(text), lambda p: p.cast("string")), ",")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", pages.alias("pages"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 w AS (SELECT event_id, user_id, ts, i, ts AS start, 1 AS nth FROM e WHERE i = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.ts, e.i, CASE WHEN e.ts - w.start >= INTERVAL 7 DAY THEN e.ts ELSE w.start END, CASE WHEN e.ts - w.start >= INTERVAL 7 DAY THEN 1 ELSE w.nth + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, nth, nth <= 10 AS allowed FROM w""")
def rate_limit(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    done = serving.fixed_windows(events, ["user_id"], ["ts", "event_id"], 10, 7 * 86_400)
    return done.select("event_id", "nth", "allowed")


_CAPS = " ".join(f"WHEN '{r}' THEN {n}" for r, n in serving.PER_MINUTE.items())


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ({list(serving.PER_MINUTE)})[event_id % 5 + 1] AS route, ts, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id) AS i FROM events),
 w AS (SELECT event_id, user_id, route, ts, i, ts AS start, 1 AS nth FROM e WHERE i = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.route, e.ts, e.i, CASE WHEN e.ts - w.start >= INTERVAL 1 MINUTE THEN e.ts ELSE w.start END, CASE WHEN e.ts - w.start >= INTERVAL 1 MINUTE THEN 1 ELSE w.nth + 1 END
  FROM w JOIN e ON e.user_id = w.user_id AND e.route = w.route AND e.i = w.i + 1),
 m AS (SELECT *, nth <= CASE route {_CAPS} END AS route_ok FROM w),
 p AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM m WHERE route_ok),
 d AS (SELECT event_id, user_id, ts, j, ts AS start, 1 AS nth FROM p WHERE j = 1 UNION ALL
  SELECT p.event_id, p.user_id, p.ts, p.j, CASE WHEN p.ts - d.start >= INTERVAL 1 DAY THEN p.ts ELSE d.start END, CASE WHEN p.ts - d.start >= INTERVAL 1 DAY THEN 1 ELSE d.nth + 1 END
  FROM d JOIN p ON p.user_id = d.user_id AND p.j = d.j + 1)
SELECT m.event_id, m.route_ok, coalesce(d.nth <= {serving.PER_DAY}, false) AS allowed FROM m LEFT JOIN d USING (event_id)""")
def rate_limit_two_level(spark, sf_dir):
    routes = F.array(*map(F.lit, serving.PER_MINUTE))
    events = read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("client"), F.element_at(routes, (F.col("event_id") % 5 + 1).cast("int")).alias("route"))
    return serving.two_level(events, order=("ts", "event_id")).select("event_id", "route_ok", "allowed")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, burst""")
def debounce_sessions(spark, sf_dir):
    return serving.debounce(read(spark, sf_dir, "events"), ["user_id"], settle="12 hours")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 413 WHEN event_id % 5 = 0 OR (props::JSON->>'k')::BIGINT >= 50 THEN 400 ELSE 200 END AS status FROM events""")
def json_validate(spark, sf_dir):
    e = F.col("event_id")
    body = F.when(e % 7 == 0, F.concat("props", F.lit(" " * 100))).when(e % 5 == 0, F.concat(F.lit("["), "props")).otherwise(F.col("props"))
    rows = read(spark, sf_dir, "events").withColumn("body", body)
    return serving.validate(rows, "k bigint", most_bytes=90, checks=F.col("parsed.k") < 50).select("event_id", "status")


@query("""SELECT event_id, (['rate limit', 'credentials', 'busy', 'timeout', 'unknown model', 'budget', 'other'])[event_id % 7 + 1] AS reason, ([429, 502, 502, 504, 502, 503, 502])[event_id % 7 + 1] AS status FROM events""")
def error_classify(spark, sf_dir):
    k = F.col("event_id") % 7
    text = F.when(k == 3, "Request Timed Out").when(k == 5, "with an Explicit Deny, status 429").when(k == 2, "model is overloaded").otherwise("failed")
    code = F.when(k == 0, 429).when(k == 1, 403).when(k == 4, 404).when(k == 5, 429).otherwise(500)
    found = serving.classify_failure(F.array(F.lit("AI_APICallError"), text), F.array(code))
    return read(spark, sf_dir, "events").select("event_id", found["reason"].alias("reason"), found["status"].alias("status"))


@query("""SELECT conv_id AS answer_id, string_agg(text, '' ORDER BY turn) FILTER (text <> '' AND turn % 5 <> 4) AS answer, max_by(text, turn) FILTER (turn % 5 = 4) AS error FROM conversations GROUP BY conv_id""")
def answer_assembly(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    rows = turns.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 5 == 4, "error").otherwise("delta").alias("kind"), "text")
    noise = rows.filter("seq = 0").select("answer_id", F.lit(-1).alias("seq"), F.explode(F.array(F.lit("not json"), F.lit('{"type":"other"}'), F.lit(""))).alias("line"))
    lines = serving.encode_events(rows).unionByName(noise)
    done = serving.assemble(serving.parse_events(lines))
    return done.select("answer_id", "answer", "error")


@query("""WITH k AS (SELECT DISTINCT substr(sha1(text), 1, 16) AS key FROM documents), c AS (SELECT DISTINCT substr(sha1(text), 1, 16) AS key FROM documents WHERE source = 'src0')
SELECT key FROM k WHERE key NOT IN (SELECT key FROM c)""")
def vector_cache_missing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    cached = docs.filter("source = 'src0'").select(T.cache_key(F.col("text")).alias("key"))
    return stores.missing_texts(docs, cached).select("key")


@query("""WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 'user' AS role, text FROM p WHERE role = 'user' AND next_role = 'assistant' AND answer <> '' UNION ALL
SELECT conv_id, turn, 'assistant', answer FROM p WHERE role = 'user' AND next_role = 'assistant' AND answer <> ''""")
def chat_history(spark, sf_dir):
    return serving.history(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", "text")


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'failed ' || turn END AS error FROM conversations)
SELECT conv_id, min(turn) FILTER (error IS NULL) AS model_ix, CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN max_by(error, turn) END AS error FROM t GROUP BY conv_id""")
def failover(spark, sf_dir):
    t = F.col("turn")
    failed = F.when((F.col("conv_id") + t) % 3 == 0, F.concat(F.lit("failed "), t.cast("string")))
    tries = read(spark, sf_dir, "conversations").select("conv_id", t.alias("model_ix"), F.when(failed.isNull(), F.col("text")).alias("response"), failed.alias("error"))
    return serving.first_success(tries, ["conv_id"]).select("conv_id", "model_ix", "error")


@query(r"""WITH s AS (SELECT source, doc_id, CASE WHEN NOT regexp_matches(text, '\d') THEN 0 ELSE (CASE WHEN regexp_matches(text, '(?i)\d\s*\|?\s*(?:mmol|µmol|umol|nmol|pmol|mg|g/|ng|pg|u/l|iu|meq|%|x?10\^|fl\b)') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(text, '(?i)\b(?:labs?|laborator(?:y|ies)|results?|serum|plasma|blood|panel|count|level|test)\b') THEN 1 ELSE 0 END) END AS signal FROM documents)
SELECT source, doc_id, signal FROM s WHERE signal > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY signal DESC, doc_id) <= 12""")
def lab_passages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", "text", F.lit("prose").alias("kind"))
    return retrieval.lab_passages(docs, ["source"], "doc_id").select("source", "doc_id", "signal")


@query(r"SELECT source AS doc_id, doc_id AS page FROM documents WHERE len(regexp_replace(text, '\s', '', 'g')) < 12")
def scanned_pages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.col("text").alias("str"))
    return layout.scanned_pages(docs, docs.select("doc_id", "page"))


@query("SELECT user_id, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_wins(spark, sf_dir):
    return serving.latest_by_ticket(read(spark, sf_dir, "events"), ["user_id"], "event_id", "value")


@query("""SELECT event_id, CASE WHEN n < 120 THEN n || CASE WHEN n = 1 THEN ' second' ELSE ' seconds' END WHEN n < 7200 THEN ceil(n / 60.0)::BIGINT || ' minutes' ELSE ceil(n / 3600.0)::BIGINT || ' hours' END AS hint
 FROM (SELECT event_id, greatest(ceil(value * value)::BIGINT, 1) AS n FROM events)""")
def retry_hints(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", serving.retry_hint(F.col("value") * F.col("value")).alias("hint"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '–' || (p_size + 2) || ' mmol/L' WHEN 1 THEN p_size || '% or below' ELSE p_size || '.5 or above' END AS shown FROM part""")
def shown_ranges(spark, sf_dir):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("double")
    low = F.when(k == 0, size).when(k == 2, size + 0.5)
    high = F.when(k == 0, size + 2).when(k == 1, size)
    unit = F.when(k == 0, "mmol/L").when(k == 1, "%")
    return read(spark, sf_dir, "part").select("p_partkey", V.format_range(low, high, unit).alias("shown"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9%]+', ' ', 'g')) AS form, trim(regexp_replace(lower(p_name), '[^a-z0-9%]+', ' ', 'g')) AS bare FROM part""")
def name_forms(spark, sf_dir):
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    forms = T.name_forms(name)
    return read(spark, sf_dir, "part").select("p_partkey", F.get(forms, F.lit(0)).alias("form"), F.element_at(forms, -1).alias("bare"))


@query("""SELECT page_id, 'file:' || page_id || '.pdf:' || strlen(html) AS doc_id, CASE WHEN page_id % 3 = 0 THEN 'type' WHEN strlen(html) > 5000 THEN NULL END AS problem,
 'file:' || page_id || '.pdf:' || strlen(html) || '|local:minilm-l6' AS vector_key FROM pages""")
def file_admission(spark, sf_dir):
    name = F.concat(F.col("page_id").cast("string"), F.lit(".pdf"))
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("x/"), name, F.lit(".html"))).otherwise(F.concat(F.lit("x/"), name))
    size = F.octet_length("html")
    key = T.document_key(name, size)
    return read(spark, sf_dir, "pages").select("page_id", key.alias("doc_id"), stores.admission(path, size).alias("problem"), T.vector_key(key, "minilm-l6").alias("vector_key"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '10.1.0.' || user_id ELSE 'unknown' END AS client FROM events""")
def client_keys(spark, sf_dir):
    e, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    real = F.when(e == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(" "))).when(e == 1, " ")
    hops = F.when(e < 2, F.concat(F.lit("10.1.0."), u, F.lit(", 10.9.9.9"))).when(e == 2, "")
    return read(spark, sf_dir, "events").select("event_id", serving.client_key(real, hops).alias("client"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS selection, len(trim(regexp_replace(text, '\s+', ' ', 'g'))) BETWEEN 2 AND 300 AND regexp_matches(text, '\p{L}') AS explainable FROM conversations""")
def selections(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_selection(F.col("text")).alias("selection"), T.is_explainable(F.col("text")).alias("explainable"))


@query(f"""SELECT doc_id, substr(sha1('Represent this sentence for searching relevant passages: ' || heading || chr(10) || text), 1, 16) AS key FROM {_HEADED}""")
def embedding_keys(spark, sf_dir):
    docs = _with_headings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", T.cache_key(T.query_text("bge-small", T.embedding_text(F.col("headings"), F.col("text")))).alias("key"))


@query(r"""WITH l AS (SELECT doc_id, i, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> ''),
 k AS (SELECT *, len(line) BETWEEN 1 AND 70 AND regexp_matches(regexp_replace(line, '\([^)]*\)', '', 'g'), '[A-Z]') AND regexp_replace(line, '\([^)]*\)', '', 'g') = upper(regexp_replace(line, '\([^)]*\)', '', 'g')) AS heading FROM l),
 g AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) * 2 + CASE WHEN heading THEN 0 ELSE 1 END AS run FROM k)
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind, sha1(string_agg(line, ' ' ORDER BY i)) AS text_sha1, count(*) AS n_lines FROM g GROUP BY doc_id, run, heading""")
def layout_blocks(spark, sf_dir):
    """Lines of a text as items of a page, one below the other, through lines and blocks."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("item_ix", "str"))
    size, zero = F.lit(10.0), F.lit(0.0)
    text = F.trim("str")
    place = F.array(size, zero, zero, size, F.lit(50.0), F.col("item_ix") * -14.0)
    items = docs.select("doc_id", F.lit(1).alias("page"), "item_ix", text.alias("str"), place.alias("transform"), (F.length(text) * 5.0).alias("width"), size.alias("height"), F.lit(None).cast("string").alias("font_name"))
    made = layout.blocks(layout.lines(items), n_lines=True)
    return made.select("doc_id", "kind", F.sha1(F.col("text").cast("binary")).alias("text_sha1"), "n_lines")


@query("""WITH c AS (SELECT c_nationkey::VARCHAR AS doc_id, (c_custkey % 2 + 1)::INTEGER AS page, c_custkey, c_name || ' | ' || c_mktsegment || ' | ' || c_acctbal::DECIMAL(12, 2)::VARCHAR AS line FROM customer),
 t AS (SELECT doc_id, page, count(*) AS n, string_agg(line, chr(10) ORDER BY c_custkey) AS rows FROM c GROUP BY doc_id, page HAVING count(*) >= 4 QUALIFY count(*) OVER (PARTITION BY doc_id) = 2)
SELECT doc_id, page, 0 AS block_ix, 'heading' AS kind, 1 AS level, sha1(CASE page WHEN 1 THEN 'Accounts with even keys' ELSE 'Accounts with odd keys' END) AS text_sha1, 0::BIGINT AS n_rows FROM t
UNION ALL SELECT doc_id, page, 1, 'table', NULL, sha1(rows), n FROM t UNION ALL SELECT doc_id, page, 2, 'paragraph', NULL, sha1('Balances are in dollars. They were read at the end of a day.'), 0 FROM t""")
def layout_tables(spark, sf_dir):
    """Whole extraction of documents with two pages of four rows at least: running header and footer, heading in a larger font, a table and prose.

    A table's row is three items in any order or, every third, one run with wide gaps.
    """
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), (F.col("c_custkey") % 2 + 1).cast("int").alias("page"), "c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("balance"))
    on_page = Window.partitionBy("doc_id", "page")
    rows = c.withColumn("n", F.count(F.lit(1)).over(on_page)).withColumn("least", F.min("n").over(Window.partitionBy("doc_id"))).withColumn("pages", F.size(F.collect_set("page").over(Window.partitionBy("doc_id"))))
    rows = rows.filter("least >= 4 AND pages = 2").withColumn("nth", F.row_number().over(on_page.orderBy("c_custkey")))
    item = lambda text, x, y, size: F.struct(text.alias("str"), F.lit(float(x)).alias("x"), (y * 14.0).alias("y"), F.lit(float(size)).alias("size"))
    down = -F.col("nth")
    apart = F.array(item(F.col("balance"), 350, down, 10), item(F.col("c_name"), 50, down, 10), item(F.col("c_mktsegment"), 200, down, 10))
    wide = F.array(item(F.concat(F.rpad("c_name", 30, " "), F.rpad("c_mktsegment", 30, " "), "balance"), 50, down, 10))
    n = F.col("n")
    title = F.when(F.col("page") == 1, "Accounts with even keys").otherwise("Accounts with odd keys")
    around = F.array(
        item(F.lit("Ledger of a nation"), 50, n, 10),
        item(title, 50, n * 0, 16),
        item(F.lit("Balances are in dollars."), 50, -n - 1, 10),
        item(F.lit("They were read at the end of a day."), 50, -n - 2, 10),
        item(F.concat(F.lit("Page "), "page", F.lit(" of 2")), 50, -2 * n, 10),
    )
    cells = F.when(F.col("c_custkey") % 3 == 0, wide).otherwise(apart)
    runs = rows.select("doc_id", "page", "nth", F.explode(F.when(F.col("nth") == 1, F.concat(around, cells)).otherwise(cells)).alias("i"))
    zero = F.lit(0.0)
    order = F.row_number().over(on_page.orderBy("nth", "i.str")).alias("item_ix")
    items = runs.select("doc_id", "page", order, "i.str", F.array("i.size", zero, zero, "i.size", "i.x", "i.y").alias("transform"), (F.length("i.str") * 5.0).alias("width"), F.col("i.size").alias("height"), F.lit(None).cast("string").alias("font_name"))
    made = layout.extract(items, rows.select("doc_id", "page").distinct())
    return made.select("doc_id", "page", "block_ix", "kind", "level", F.sha1(F.col("text").cast("binary")).alias("text_sha1"), F.coalesce(F.size("rows"), F.lit(0)).cast("long").alias("n_rows"))


@query("""SELECT p_partkey, 3 AS fakes, p_size + 1000 AS wrong_page, printf('%.2f', p_retailprice + 0.37) AS wrong_value FROM part""")
def fabrications(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_retailprice").cast("string").alias("value"), F.col("p_size").alias("page"))
    fakes = E.fabricate(rows)
    return fakes.groupBy("p_partkey").agg(
        F.count(F.lit(1)).cast("int").alias("fakes"), F.max(F.when(F.col("fake") == "page", F.col("page"))).alias("wrong_page"), F.max(F.when(F.col("fake") == "value", F.col("value"))).alias("wrong_value")
    )
