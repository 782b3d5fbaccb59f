"""Registered queries of the retrieval engine and their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.stemming import porter_stem
from lodestone.operators import index as ix
from lodestone.operators import ranking as rk
from lodestone.operators import reports
from lodestone.operators.stop_words import STOP_WORDS
from lodestone.operators.storage import materialize, shared_dir
from lodestone.plans import sql as S
from lodestone.sources import corpus as src

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SINGLE = "apache license version"
CITIES = ("apache", "gnu", "mit", "china")
RELATED = (("apache", "mit", 1), ("apache", "gnu", 2), ("apache", "rights", 3), ("license", "licensed", 1), ("license", "zzz", 2), ("license", "mit", 3), ("license", "general", 4))


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.from_tables(spark, sf_dir)


def _occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.occurrences(_docs(spark, sf_dir))


def _post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(_occ(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings for plans that read them more than once."""
    return materialize(_post(spark, sf_dir), "postings")


#: Indexes of this session by application, folder, source and analysis: a table is indexed once and then searched.
INDEXES: dict[tuple, ix.Index] = {}


def _index(spark: SparkSession, sf_dir: str, source: str = "documents", analyzer: str = "simple") -> ix.Index:
    """The written index of a driver table, which doesn't change while a session lasts."""
    key = spark.sparkContext.applicationId, sf_dir, source, analyzer
    if key not in INDEXES:
        docs = _docs(spark, sf_dir) if source == "documents" else src.from_pages(spark, sf_dir)
        path = f"{shared_dir(spark)}/lodestone/index-{uuid.uuid4().hex}"
        ix.write(ix.build(docs, analyzer=analyzer, cities=spark.createDataFrame([(c,) for c in CITIES], "city string")), path)
        INDEXES[key] = ix.open_index(spark, path)
    return INDEXES[key]


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.term_dictionary(_post(spark, sf_dir), 0)


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.col("item_id").cast("string").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("title"), F.col("text").alias("description"))


TOPICS = "topics AS (SELECT item_id::VARCHAR AS query_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS title, text AS description FROM benchmark)"
IDX = S.index()


@query(f"SELECT doc_id, pos, token FROM (SELECT doc_id, unnest(ts) AS token, (generate_subscripts(ts, 1) - 1)::INTEGER AS pos FROM (SELECT doc_id, {S.tokens('text')} AS ts FROM documents))")
def tokenize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.tokenize(F.col("text"))).alias("pos", "token"))


@query(f"SELECT doc_id, pos, {S.clean('token')} AS token FROM ({ORACLES['tokenize']})")
def clean_tokens(spark, sf_dir):
    return tokenize(spark, sf_dir).withColumn("token", X.clean_token(F.col("token")))


@query(f"WITH t AS ({ORACLES['clean_tokens']}) SELECT doc_id, pos, token FROM t WHERE lower(token) NOT IN ({S.STOP})")
def stop_filter(spark, sf_dir):
    return clean_tokens(spark, sf_dir).filter(~F.lower("token").isin(*sorted({*STOP_WORDS, *X.DROPPED})))


@query(f"SELECT DISTINCT lower(token) AS term FROM ({ORACLES['clean_tokens']}) WHERE contains(token, '-') AND len(list_filter(string_split(lower(token), '-'), lambda p: p <> '' AND length(p) < 2)) = 0")
def hyphen_filter(spark, sf_dir):
    return clean_tokens(spark, sf_dir).select(F.lower("token").alias("term")).filter(F.col("term").contains("-") & X.hyphens_ok(F.col("term"))).distinct()


@query(f"SELECT DISTINCT token FROM ({ORACLES['clean_tokens']}) WHERE NOT (length(token) >= 2 AND NOT regexp_matches(token, '{S.REJECT}'))")
def reject_filter(spark, sf_dir):
    t = F.col("token")
    return clean_tokens(spark, sf_dir).select("token").filter(~((F.length(t) >= 2) & ~t.rlike(X.REJECT))).distinct()


@query(f"WITH {IDX} SELECT doc_id, pos, term, is_upper FROM occ")
def term_occurrences(spark, sf_dir):
    return _occ(spark, sf_dir).select("doc_id", "pos", "term", "is_upper")


@query(f"WITH {IDX} SELECT doc_id, term, tf FROM post")
def term_doc_tf(spark, sf_dir):
    return _post(spark, sf_dir).select("doc_id", "term", "tf")


@query(f"WITH {IDX} SELECT * FROM terms")
def term_dictionary(spark, sf_dir):
    return _terms(spark, sf_dir).drop("display_term")


@query(f"WITH {IDX} SELECT term, CASE WHEN is_entity THEN upper(replace(term, 'ß', 'ss')) ELSE term END AS display_term, total_tf FROM terms")
def dictionary_view(spark, sf_dir):
    return _terms(spark, sf_dir).select("term", "display_term", "total_tf").orderBy("term")


@query(f"WITH {IDX} SELECT s.*, d.source AS parent_file FROM stats s JOIN documents d USING (doc_id)")
def doc_stats(spark, sf_dir):
    return ix.doc_stats(_post(spark, sf_dir), _docs(spark, sf_dir)).drop("headers", "city")


@query(f"WITH {IDX} SELECT * FROM corpus")
def corpus_stats(spark, sf_dir):
    return ix.corpus_stats(ix.doc_stats(_post(spark, sf_dir), _docs(spark, sf_dir)))


@query(f"WITH {IDX} SELECT doc_id, most_freq_term, max_tf FROM stats")
def doc_most_freq_term(spark, sf_dir):
    return ix.doc_stats(_post(spark, sf_dir), _docs(spark, sf_dir)).select("doc_id", "most_freq_term", "max_tf")


@query(f"WITH {IDX} SELECT doc_id, n_unique FROM stats")
def unique_terms_per_doc(spark, sf_dir):
    return _post(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_unique"))


@query(f"WITH {IDX} SELECT term, is_entity FROM terms")
def entity_flag(spark, sf_dir):
    return _terms(spark, sf_dir).select("term", "is_entity")


@query(
    f"WITH {IDX}, r AS (SELECT p.doc_id, upper(replace(p.term, 'ß', 'ss')) AS entity, p.tf, (row_number() OVER (PARTITION BY p.doc_id ORDER BY p.tf DESC, p.term))::INTEGER AS rank FROM post p JOIN terms t USING (term) WHERE t.is_entity) SELECT * FROM r WHERE rank <= 5"
)
def doc_entities_top5(spark, sf_dir):
    post = _kept(spark, sf_dir)
    return ix.doc_entities(post, ix.term_dictionary(post, 0))


HEADS = S.occurrences("head", S.PAGES_HEAD)


@query(f"WITH {HEADS} SELECT DISTINCT term, doc_id, is_upper FROM head WHERE regexp_matches(term, '^\\p{{L}}')")
def header_index(spark, sf_dir):
    return ix.header_index(src.from_pages(spark, sf_dir))


@query("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL AND NOT regexp_matches(lang, '^[0-9.,]+$')")
def language_list(spark, sf_dir):
    return src.languages(_docs(spark, sf_dir))


@query(f"WITH {IDX}, n AS (SELECT count(*) * 1000 AS n FROM documents) SELECT term, df, total_tf FROM terms, n WHERE NOT (df < n // 100000 + 1 AND total_tf <= 3)")
def rare_term_filter(spark, sf_dir):
    """As if the corpus had a thousand times its documents, so that the filter bites."""
    terms = _terms(spark, sf_dir)
    n = _docs(spark, sf_dir).count() * 1000
    return terms.filter(ix.common(n)).select("term", "df", "total_tf")


@query(f"WITH {IDX} SELECT term, total_tf FROM terms ORDER BY total_tf, term LIMIT 10")
def least_freq_terms(spark, sf_dir):
    return reports.extreme_terms(_terms(spark, sf_dir), most=False)


@query(f"WITH {IDX} SELECT term, total_tf FROM terms ORDER BY total_tf DESC, term LIMIT 10")
def most_freq_terms(spark, sf_dir):
    return reports.extreme_terms(_terms(spark, sf_dir))


@query(f"WITH {IDX} SELECT term, doc_id, tf FROM post ORDER BY tf DESC, term, doc_id LIMIT 1")
def global_max_tf(spark, sf_dir):
    return reports.greatest_tf(_post(spark, sf_dir))


@query(f"WITH {IDX} SELECT 'terms' AS what, count(*) AS n FROM terms UNION ALL SELECT 'documents', count(*) FROM stats")
def run_summary(spark, sf_dir):
    post = _kept(spark, sf_dir)
    return reports.run_summary(ix.term_dictionary(post, 0), post.select("doc_id").distinct())


def _scored(spark: SparkSession, sf_dir: str, topics: DataFrame) -> DataFrame:
    index = _index(spark, sf_dir)
    terms = rk.distinct_terms(rk.query_terms(topics, "title")).withColumns({"in_title": F.lit(True), "in_desc": F.lit(False)})
    found = ix.probe(terms, index.terms)
    rows = rk.term_weights(rk.candidates(found, ix.posting_rows(index, found), index.doc_stats), index.corpus_stats)
    return rk.bm25(rows).select("query_id", "doc_id", F.round("s1", 6).alias("score"))


def _bm25_sql(topics: str) -> str:
    return f"""WITH {IDX}, {S.occurrences("qo", topics)},
q AS (SELECT DISTINCT doc_id AS query_id, term, is_upper FROM qo),
cand AS (SELECT q.*, p.doc_id, p.tf, s.doc_len FROM q JOIN post p USING (term) JOIN stats s ON s.doc_id = p.doc_id),
{S.WEIGHTS},
scores AS (SELECT query_id, doc_id, round(sum(2 * w), 6) AS score FROM weighed GROUP BY query_id, doc_id)"""


SINGLE_SQL = _bm25_sql(f"SELECT 'single query' AS doc_id, {S.quoted(SINGLE)} AS text")
BATCH_SQL = _bm25_sql("SELECT item_id::VARCHAR AS doc_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS text FROM benchmark")
RANKED_SQL = "r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC))::INTEGER AS rank, doc_id, score FROM scores) SELECT * FROM r WHERE rank <= 50"


@query(f"{SINGLE_SQL} SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id DESC LIMIT 50")
def bm25_single_query(spark, sf_dir):
    topics = spark.createDataFrame([("single query", SINGLE)], "query_id string, title string")
    return _scored(spark, sf_dir, topics).select("doc_id", "score").orderBy(F.desc("score"), F.desc("doc_id")).limit(50)


@query(f"{BATCH_SQL} SELECT * FROM scores")
def bm25_topics_batch(spark, sf_dir):
    return _scored(spark, sf_dir, _topics(spark, sf_dir))


@query(f"{BATCH_SQL}, {RANKED_SQL}")
def topk_per_query(spark, sf_dir):
    return rk.ranked(_scored(spark, sf_dir, _topics(spark, sf_dir)))


@query(f"WITH r AS ({BATCH_SQL}, {RANKED_SQL}) SELECT concat_ws(' ', query_id, '0', doc_id, '1', 'float-sim', 'mt') AS line FROM r")
def trec_output(spark, sf_dir):
    return reports.to_trec(topk_per_query(spark, sf_dir))


@query(f"WITH r AS ({BATCH_SQL}, {RANKED_SQL}) SELECT rank::VARCHAR || '. ' || doc_id::VARCHAR AS line FROM r UNION ALL SELECT DISTINCT '----QUERY ID: ' || query_id || '----' FROM r")
def result_listing(spark, sf_dir):
    return reports.to_listing(topk_per_query(spark, sf_dir))


def _in(words) -> str:
    return ", ".join(S.quoted(w) for w in words)


CITY_SQL = f"SELECT upper(p.term) AS city, p.doc_id, p.tf FROM post p JOIN terms t USING (term) WHERE t.is_entity AND p.term IN ({_in(CITIES)}) AND p.term <> 'china'"


def _city_docs(spark: SparkSession, post: DataFrame) -> DataFrame:
    cities = spark.createDataFrame([(c,) for c in CITIES], "city string")
    return ix.city_docs(post, ix.term_dictionary(post, 0), cities)


@query(f"WITH {IDX} {CITY_SQL}")
def city_index(spark, sf_dir):
    return _city_docs(spark, _kept(spark, sf_dir))


@query(f"WITH {IDX}, c AS ({CITY_SQL}) SELECT p.doc_id, p.term, p.tf FROM post p WHERE p.term = 'license' AND p.doc_id IN (SELECT doc_id FROM c WHERE city IN ('APACHE', 'MIT'))")
def city_semi_filter(spark, sf_dir):
    post = _kept(spark, sf_dir)
    allowed = _city_docs(spark, post).filter(F.col("city").isin("APACHE", "MIT")).select("doc_id").distinct()
    return post.filter("term = 'license'").join(allowed, "doc_id", "left_semi").select("doc_id", "term", "tf")


TOPIC_TERMS = f"""{TOPICS}, {S.occurrences("to_", "SELECT query_id AS doc_id, title AS text FROM topics")}, {S.occurrences("de_", "SELECT query_id AS doc_id, description AS text FROM topics")},
tt AS (SELECT doc_id AS query_id, pos, term, is_upper FROM to_), dd AS (SELECT doc_id AS query_id, pos, term, is_upper FROM de_),
rest AS (
  SELECT query_id, pos, term, is_upper FROM (SELECT *, row_number() OVER (PARTITION BY query_id, term, is_upper ORDER BY pos) AS k FROM dd) x
  WHERE NOT (term = 'document' AND k = 1) AND NOT EXISTS (SELECT 1 FROM tt WHERE tt.query_id = x.query_id AND tt.term = x.term AND tt.is_upper = x.is_upper)),
gate AS (
  SELECT q.query_id FROM topics q WHERE (SELECT count(*) FROM dd WHERE dd.query_id = q.query_id) >= 2 * (SELECT count(*) FROM tt WHERE tt.query_id = q.query_id)
  AND (EXISTS (SELECT 1 FROM dd WHERE dd.query_id = q.query_id) OR EXISTS (SELECT 1 FROM tt WHERE tt.query_id = q.query_id)))"""
EXPANSION = """last AS (SELECT query_id, df, last(term ORDER BY pos) AS term, last(is_upper ORDER BY pos) AS is_upper FROM (SELECT r.*, coalesce(t.df, -1) AS df FROM rest r LEFT JOIN terms t USING (term)) GROUP BY query_id, df),
expn AS (SELECT query_id, term, is_upper, df FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM last) WHERE n % 2 = 0 OR k <> (n + 1) / 2)"""


@query(f"WITH {TOPIC_TERMS} SELECT query_id, pos, term, is_upper FROM rest")
def desc_minus_title(spark, sf_dir):
    topics = _topics(spark, sf_dir)
    return rk.minus_title(rk.query_terms(topics, "description"), rk.query_terms(topics, "title"))


@query(f"WITH {TOPIC_TERMS} SELECT query_id FROM gate")
def expansion_gate(spark, sf_dir):
    topics = _topics(spark, sf_dir)
    return rk.wants_expansion(rk.query_terms(topics, "title"), rk.query_terms(topics, "description"))


@query(f"WITH {IDX}, {TOPIC_TERMS}, {EXPANSION} SELECT query_id, term, is_upper, df FROM expn")
def desc_expansion(spark, sf_dir):
    topics = _topics(spark, sf_dir)
    rest = rk.minus_title(rk.query_terms(topics, "description"), rk.query_terms(topics, "title"))
    return rk.expansion(rest, _terms(spark, sf_dir))


RELATED_SQL = "syn(origin, related, rank) AS (VALUES " + ", ".join(f"({S.quoted(a)}, {S.quoted(b)}, {k})" for a, b, k in RELATED) + ")"
SYNONYM_SQL = """f AS (SELECT q.doc_id AS query_id, q.term AS origin, min(q.pos) AS begin_at, s.related AS term, s.rank FROM qo q JOIN syn s ON s.origin = q.term WHERE s.related IN (SELECT term FROM terms) GROUP BY ALL),
o_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, term ORDER BY begin_at, rank) AS n FROM f),
k AS (SELECT query_id, term, false AS is_upper, origin, (row_number() OVER (PARTITION BY query_id, origin ORDER BY rank, term))::INTEGER AS rank FROM o_ WHERE n = 1)"""


@query(
    f"""WITH {IDX}, {S.occurrences("qo", f"SELECT 'q' AS doc_id, {S.quoted(SINGLE)} AS text")}, {RELATED_SQL}, {SYNONYM_SQL} SELECT * FROM k WHERE rank <= 2"""
)
def synonym_expansion(spark, sf_dir):
    topics = spark.createDataFrame([("q", SINGLE)], "query_id string, title string")
    synonyms = spark.createDataFrame(list(RELATED), "term string, related string, rank int")
    return rk.synonym_terms(rk.query_terms(topics, "title"), synonyms, _terms(spark, sf_dir))


HEADLINES = """size AS (SELECT doc_id, count(*) AS size FROM heads GROUP BY doc_id),
hit AS (SELECT query_id, doc_id, count(*) AS n1, sum(CASE WHEN regexp_matches(term, '[^ -][ -]+[^ -]') THEN 2 ELSE 0 END) AS b1 FROM qq JOIN (SELECT DISTINCT term, doc_id FROM heads) USING (term) GROUP BY query_id, doc_id),
more AS (SELECT query_id, doc_id, sum(CASE WHEN regexp_matches(term, '[^ -][ -]+[^ -]') THEN 2 ELSE 0 END) AS b2 FROM dq JOIN (SELECT DISTINCT term, doc_id FROM heads) USING (term) GROUP BY query_id, doc_id),
hh AS (SELECT query_id, doc_id, coalesce(n1, 0)::DOUBLE / size * CASE WHEN coalesce(b1, 0) <> 0 THEN b1 ELSE 1 END * CASE WHEN coalesce(b2, 0) <> 0 THEN b2 ELSE 1 END AS h
  FROM hit FULL JOIN more USING (query_id, doc_id) JOIN size USING (doc_id))"""
PAGE_HEADS = f"{HEADS}, heads AS (SELECT DISTINCT term, doc_id, is_upper FROM head WHERE regexp_matches(term, '^\\p{{L}}'))"


@query(f"WITH {PAGE_HEADS}, {TOPIC_TERMS}, qq AS (SELECT DISTINCT query_id, term, is_upper FROM tt), dq AS (SELECT DISTINCT query_id, term, is_upper FROM dd), {HEADLINES} SELECT query_id, doc_id, round(h, 6) AS h FROM hh")
def header_bonus(spark, sf_dir):
    topics = _topics(spark, sf_dir)
    title, desc = (rk.distinct_terms(rk.query_terms(topics, c)) for c in ("title", "description"))
    return rk.headline_scores(title, desc, ix.header_index(src.from_pages(spark, sf_dir))).withColumn("h", F.round("h", 6))


@query(
    f"""WITH {S.index(S.PAGES_BODY)}, {PAGE_HEADS}, {TOPIC_TERMS}, {EXPANSION},
dq AS (SELECT DISTINCT query_id, term, is_upper FROM (SELECT query_id, term, is_upper FROM dd WHERE query_id NOT IN (SELECT query_id FROM gate) UNION ALL SELECT query_id, term, is_upper FROM rest WHERE query_id IN (SELECT query_id FROM gate))),
orig AS (SELECT DISTINCT query_id, term, is_upper FROM tt),
qq AS (SELECT query_id, term, is_upper FROM orig UNION SELECT query_id, term, is_upper FROM expn WHERE query_id IN (SELECT query_id FROM gate)),
{HEADLINES},
cand AS (SELECT q.query_id, q.term, q.is_upper, p.doc_id, p.tf, s.doc_len,
  EXISTS (SELECT 1 FROM orig o WHERE o.query_id = q.query_id AND o.term = q.term AND o.is_upper = q.is_upper) AS in_title,
  EXISTS (SELECT 1 FROM dq o WHERE o.query_id = q.query_id AND o.term = q.term AND o.is_upper = q.is_upper) AS in_desc
  FROM qq q JOIN post p USING (term) JOIN stats s ON s.doc_id = p.doc_id),
{S.WEIGHTS},
two AS (SELECT query_id, doc_id, sum(w * CASE WHEN in_title THEN 2 ELSE 1 END) AS s1, sum(CASE WHEN in_desc THEN w * CASE WHEN in_title THEN 2 ELSE 1 END ELSE 0 END) AS s2 FROM weighed GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(1.281 * s1 + 0.05 * s2 + 8.55 * coalesce(h, 0), 6) AS score FROM two LEFT JOIN hh USING (query_id, doc_id)"""
)
def full_score(spark, sf_dir):
    return rk.search(_index(spark, sf_dir, "pages"), _topics(spark, sf_dir), limit=None).select("query_id", "doc_id", F.round("score", 6).alias("score"))


#: Amounts from a hundredth of an order's price to millions of it, some with commas.
ORDERED = "o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate AS dated FROM orders), am AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN cents // 100000 WHEN 1 THEN cents // 100 WHEN 2 THEN cents ELSE cents * 1000 END AS n FROM o), shown AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN format('{:,}', n) ELSE n::VARCHAR END AS token FROM am)"


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderdate").alias("at"))
    kind, cents = F.col("o_orderkey") % 4, F.col("cents")
    n = F.when(kind == 0, F.floor(cents / 100000)).when(kind == 1, F.floor(cents / 100)).when(kind == 2, cents).otherwise(cents * 1000).cast("long")
    rows = rows.withColumn("n", n)
    return rows.withColumn("token", F.when(F.col("o_orderkey") % 2 == 0, F.format_number("n", 0)).otherwise(F.col("n").cast("string")))


@query(
    f"""WITH {ORDERED} SELECT o_orderkey, token, CASE WHEN n <= 999 THEN n::DOUBLE WHEN n <= 999999 THEN n / 1000 WHEN n <= 999999999 THEN n / 1000000 ELSE n / 1e9 END AS value,
CASE WHEN n <= 999 THEN '' WHEN n <= 999999 THEN 'K' WHEN n <= 999999999 THEN 'M' ELSE 'B' END AS unit FROM shown"""
)
def number_normalise(spark, sf_dir):
    rows = _ordered(spark, sf_dir).withColumn("term", X.number_term(F.col("token")))
    return rows.select("o_orderkey", "token", F.regexp_replace("term", "[KMB]$", "").cast("double").alias("value"), F.regexp_extract("term", "([KMB]?)$", 1).alias("unit"))


@query(
    f"""WITH {ORDERED} SELECT o_orderkey, '$' || token AS amount, CASE WHEN n <= 999999 THEN token || ' Dollars' WHEN n % 1000000 = 0 THEN (n // 1000000) || ' M Dollars' ELSE (n / 1000000)::VARCHAR || ' M Dollars' END AS term FROM shown"""
)
def price_normalise(spark, sf_dir):
    return _ordered(spark, sf_dir).select("o_orderkey", F.concat(F.lit("$"), "token").alias("amount")).withColumn("term", X.price_term(F.col("amount")))


@query(
    f"WITH {ORDERED} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN upper(strftime(dated, '%B')) ELSE strftime(dated, '%B') END AS month, strftime(dated, '%m-%d') AS day_term, strftime(dated, '%Y-%m') AS year_term FROM o"
)
def date_normalise(spark, sf_dir):
    name = F.date_format("at", "MMMM")
    rows = _ordered(spark, sf_dir).withColumn("month", F.when(F.col("o_orderkey") % 3 == 0, F.upper(name)).otherwise(name))
    day, year = F.dayofmonth("at").cast("string"), F.year("at").cast("string")
    return rows.select("o_orderkey", "month", X.day_term(F.col("month"), day).alias("day_term"), X.year_term(F.col("month"), year).alias("year_term"))


@query(f"WITH {ORDERED} SELECT o_orderkey, n AS people, CASE WHEN n > 1000000 THEN 'M' || (((n + 5000) // 10000) / 100)::VARCHAR ELSE n::VARCHAR END AS shown FROM shown")
def population_format(spark, sf_dir):
    return _ordered(spark, sf_dir).select("o_orderkey", F.col("n").alias("people"), X.population_text(F.col("n")).alias("shown"))


# Texts for the full rules are put together from columns, as no text table has prices or dates.


def _parsed(rows: DataFrame) -> DataFrame:
    """doc_id, pos, term, is_upper of rows (doc_id, text) by the full rules; pos counts a document's terms."""
    return ix.occurrences(rows, analyzer="full").select("doc_id", "pos", "spelling", "is_upper")


def _as_rows(terms: str, source: str) -> str:
    """SQL for doc_id, pos, spelling, is_upper from a list of structs (t, u), empty terms left out."""
    return f"SELECT doc_id, (generate_subscripts(ts, 1) - 1)::INTEGER AS pos, unnest(ts).t AS spelling, unnest(ts).u AS is_upper FROM (SELECT doc_id, list_filter({terms}, lambda x: x.t IS NOT NULL) AS ts FROM ({source}))"


def _terms_sql(*pairs: tuple[str, bool]) -> str:
    return "[" + ", ".join(f"{{'t': {t}, 'u': {str(u).lower()}}}" for t, u in pairs) + "]"


@query(
    f"WITH {ORDERED} "
    + _as_rows(
        _terms_sql(
            ("md", False), ("'grain'", False), ("CASE WHEN n <= 999999 THEN token || ' Dollars' WHEN n % 1000000 = 0 THEN (n // 1000000) || ' M Dollars' ELSE (n / 1000000)::VARCHAR || ' M Dollars' END", False), ("'sold'", False),
            ("ym", False), ("dd || 'K'", False), ("'ships'", False), ("md", False), ("dd || ' M Dollars'", False), ("dd || '000 M Dollars'", False), ("'left'", False), ("dd || ' M Dollars'", False), ("'rye'", False), ("dd || ' 3/4 Dollars'", False), ("dd || ' 3/4'", False), ("dd || ',000 Dollars'", False), ("dd || '000B'", False), ("'oats'", False), ("'corn'", False),
        ),
        "SELECT o_orderkey AS doc_id, n, token, strftime(dated, '%m-%d') AS md, strftime(dated, '%Y-%m') AS ym, (o_orderkey % 89 + 10)::VARCHAR AS dd FROM shown",
    )
)
def amounts_and_dates(spark, sf_dir):
    """The full rules of numbers, prices and dates over a sentence for each order."""
    d, month, nn = F.dayofmonth("at").cast("string"), F.date_format("at", "MMMM"), (F.col("o_orderkey") % 89 + 10).cast("string")
    parts = [month, d, "grain", F.concat(F.lit("$"), "token"), "sold", month, F.year("at").cast("string"), nn, "Thousand", "ships", d, F.lower(month), F.concat(F.lit("$"), nn), "million", nn, "billion", "left", F.concat(nn, F.lit("m")), "Dollars", "rye", nn, "3/4", "Dollars", nn, "3/4", F.concat(nn, F.lit(",000")), "Dollars", nn, "Trillion", "oats", nn, "percent", F.concat(nn, F.lit("%")), "corn"]
    text = F.concat_ws(" ", *[F.lit(x) if isinstance(x, str) else x for x in parts])
    return _parsed(_ordered(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))


@query(
    _as_rows(
        "list_concat(" + _terms_sql(("p_name", False)) + ", " + _terms_sql(("a", False), ("b", False), ("'near'", False), ("a", True), ("p_name", True), ("b", True), ("p_name", True), ("'made'", False), ("a || '-' || b", False), ("a", False), ("b", False), ("'u.s.a'", True)) + ")",
        "SELECT p_partkey AS doc_id, p_name, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part",
    )
)
def phrases(spark, sf_dir):
    """Quoted phrases, runs of capitalised words, hyphenated and joint words of the full rules over a sentence for each part."""
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    quoted, capital = F.concat(F.lit('"'), "p_name", F.lit('"')), F.initcap("p_name")
    text = F.concat_ws(" ", quoted, F.lit("near"), capital, F.lit("made"), F.concat(a, F.lit("-"), b), F.concat(a, F.lit("."), b), F.lit("U.S.A."))
    return _parsed(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


@query("SELECT '1' AS query_id, d.doc_id, d.source AS parent_file FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1")
def qrels_join(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.lit("1").alias("query_id"), "doc_id", F.col("quality").alias("relevance"))
    return reports.judged_files(labels, _docs(spark, sf_dir))


@query("SELECT doc_id, term, tf FROM (" + f"WITH {S.occurrences('occ', 'SELECT conv_id AS doc_id, text FROM conversations')} SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY doc_id, term)")
def conversation_postings(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "text")
    return ix.postings(ix.occurrences(turns)).select("doc_id", "term", "tf")


@query()
def full_parse(spark, sf_dir):
    """All rules: doc_id, pos, term, is_upper."""
    return ix.occurrences(_docs(spark, sf_dir), analyzer="full").select("doc_id", "pos", "term", "is_upper")


@query()
def capital_runs(spark, sf_dir):
    """Phrases of capitalised words and how many documents have them."""
    occ = ix.occurrences(_docs(spark, sf_dir), analyzer="full").filter("is_upper AND term LIKE '% %'")
    return occ.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("df"))


@query()
def stems(spark, sf_dir):
    """Each distinct term is stemmed once."""
    return _terms(spark, sf_dir).select("term").withColumn("stem", porter_stem("term"))


@query()
def stemmed_index(spark, sf_dir):
    post = _kept(spark, sf_dir)
    vocabulary = post.select("term").distinct().withColumn("stem", porter_stem("term"))
    return post.join(vocabulary, "term").groupBy("stem").agg(F.count_distinct("doc_id").alias("df"), F.sum("tf").alias("total_tf"))


@query()
def full_search(spark, sf_dir):
    """All rules, headlines, expansion, top 50 of each benchmark topic over the pages."""
    index = _index(spark, sf_dir, "pages", "full")
    return rk.search(index, _topics(spark, sf_dir), analyzer="full").withColumn("score", F.round("score", 6))



@query(f"SELECT DISTINCT token FROM ({ORACLES['clean_tokens']}) WHERE {S.number('token')}")
def number_predicate(spark, sf_dir):
    return clean_tokens(spark, sf_dir).select("token").filter(X.is_number(F.col("token"))).distinct()


@query("SELECT DISTINCT token FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) WHERE len(list_filter(string_split(token, '.'), lambda p: regexp_matches(p, '^\\p{Lu}$'))) > 0")
def initials(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode(F.split("text", " ", -1)).alias("token"))
    return words.filter(X.has_initial(F.split("token", "\\."))).distinct()


@query(f"WITH {HEADS} SELECT term, count(DISTINCT doc_id) AS df, list_sort(list(DISTINCT doc_id))::VARCHAR AS docs FROM head WHERE regexp_matches(term, '^\\p{{L}}') GROUP BY term")
def header_dictionary(spark, sf_dir):
    rows = ix.header_index(src.from_pages(spark, sf_dir)).groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    shown = F.concat(F.lit("["), F.array_join(F.transform("ids", lambda d: d.cast("string")), ", "), F.lit("]"))
    return rows.select("term", F.size("ids").cast("long").alias("df"), shown.alias("docs"))


@query(
    """WITH c AS (SELECT n_name AS name, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ' City' END AS capital, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) * 12345 AS people, substr(r_name, 1, 3) AS money FROM nation JOIN region ON r_regionkey = n_regionkey),
d AS (SELECT *, CASE WHEN people > 1000000 THEN 'M' || (((people + 5000) // 10000) / 100)::VARCHAR ELSE people::VARCHAR END AS shown FROM c),
p AS (SELECT DISTINCT CASE WHEN s_suppkey % 10 = 9 THEN s_name ELSE n_name END AS city FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT city, coalesce(a.name, b.name) AS country, coalesce(a.money, b.money) AS currency, coalesce(a.shown, b.shown) AS population
FROM p LEFT JOIN d a ON lower(city) = lower(a.capital) LEFT JOIN d b ON lower(city) = lower(string_split(b.capital, ' ')[1])"""
)
def city_enrichment(spark, sf_dir):
    """Cities of suppliers with the country whose capital they are; countries come as a JSON feed, made from nations."""
    nation, region, customer, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region", "customer", "supplier"))
    people = customer.groupBy("c_nationkey").agg((F.count("*") * 12345).alias("population"))
    rows = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).join(people, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    capital = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(" City")).alias("capital")
    money = F.array(F.struct(F.substring("r_name", 1, 3).alias("code"))).alias("currencies")
    feed = rows.select(F.to_json(F.array(F.struct(F.col("n_name").alias("name"), capital, F.coalesce("population", F.lit(0)).alias("population"), money))).alias("json"))
    places = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    cities = places.select(F.when(F.col("s_suppkey") % 10 == 9, F.col("s_name")).otherwise(F.col("n_name")).alias("city")).distinct()
    return src.city_info(cities, src.countries_from_json(feed))


@query("WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents) SELECT token, NOT regexp_matches(token, '[a-z]') AS all_upper, token = 'U.S.' AS is_expression FROM t")
def case_predicates(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode(F.split("text", " ", -1)).alias("token")).distinct()
    return words.select("token", X.all_upper(F.col("token")).alias("all_upper"), X.is_expression(F.col("token")).alias("is_expression"))


@query(
    f"""WITH {IDX}, {S.occurrences("qo", f"SELECT 'q' AS doc_id, {S.quoted(SINGLE)} AS text")}, {RELATED_SQL}, {SYNONYM_SQL}, c AS ({CITY_SQL}),
qq AS (SELECT DISTINCT doc_id AS query_id, term, is_upper, true AS in_title FROM qo UNION ALL SELECT query_id, term, is_upper, false FROM k WHERE rank <= 2 AND term NOT IN (SELECT term FROM qo WHERE NOT is_upper)),
cand AS (SELECT q.*, p.doc_id, p.tf, s.doc_len FROM qq q JOIN post p USING (term) JOIN stats s ON s.doc_id = p.doc_id WHERE p.doc_id IN (SELECT doc_id FROM c WHERE city IN ('APACHE', 'MIT'))),
{S.WEIGHTS},
scores AS (SELECT query_id, doc_id, round(1.281 * sum(w * CASE WHEN in_title THEN 2 ELSE 1 END), 6) AS score FROM weighed GROUP BY query_id, doc_id),
{RANKED_SQL}"""
)
def city_search(spark, sf_dir):
    """A search with synonyms in the documents of two cities."""
    topics = spark.createDataFrame([("q", SINGLE, "")], "query_id string, title string, description string")
    synonyms = spark.createDataFrame(list(RELATED), "term string, related string, rank int")
    out = rk.search(_index(spark, sf_dir), topics, cities=["Apache", "mit"], synonyms=synonyms, limit=None)
    return rk.ranked(out.withColumn("score", F.round("score", 6)).select("query_id", "doc_id", "score"))


@query(
    f"{BATCH_SQL}, {RANKED_SQL.replace('SELECT * FROM r', 'SELECT r.query_id, r.rank, d.doc_id, d.source AS parent_file, s.most_freq_term, s.max_tf, s.n_unique, s.doc_len FROM r JOIN stats s ON s.doc_id = r.doc_id JOIN documents d ON d.doc_id = r.doc_id')}"
)
def document_details(spark, sf_dir):
    """Details of the documents of a ranked result."""
    details = _index(spark, sf_dir).doc_stats.select("doc_id", "parent_file", "most_freq_term", "max_tf", "n_unique", "doc_len")
    return topk_per_query(spark, sf_dir).drop("score").join(details, "doc_id")


@query(f"{BATCH_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM scores) SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM n WHERE rank <= n // 2 + 1 AND rank <= 50")
def half_cutoff(spark, sf_dir):
    return rk.ranked(_scored(spark, sf_dir, _topics(spark, sf_dir)), reference_cutoff=True)
