"""Queries over the test tables, one or more per operator, with the SQL to compare them with.

Every query runs over its whole tables. Where SQL can't express an operator, or is too slow on whole tables,
the query has none and a test compares the operator with brute force on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.labels import NOUN_TAGS, SUBJECTS, VERB_TAGS
from corpusmill.operators import graph, grouping, segments, sentence_graph, terms, vectors, wiki, windows
from corpusmill.plans.lineage import written
from corpusmill.providers.tokens import rule_tokens as rule_tokens_of
from corpusmill.sources.tables import table as read_table

DIM = 64
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function of (table) as a query; table(name) reads a table of the folder."""

    def register(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(lambda name: read_table(spark, folder, name))

        QUERIES[f.__name__.rstrip("_")] = run
        if sql is not None:
            SQL[f.__name__.rstrip("_")] = sql
        return f

    return register


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- terms ----------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in sorted(set(terms.STOP_WORDS)))
_CAND = rf"""cand AS (
  SELECT doc_id, trim(t) AS term FROM (
    SELECT doc_id, unnest(string_split(array_to_string(list_transform(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: CASE WHEN x IN ({_STOP}) THEN '|' ELSE x END), ' '), '|')) AS t
    FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
  WHERE trim(t) <> '' AND len(regexp_extract_all(trim(t), '\S+')) BETWEEN 1 AND 4),
cnt AS (SELECT doc_id, term, count(*) AS cnt FROM cand GROUP BY doc_id, term)"""
_SUBS = """list_filter(flatten(list_transform(range(1, n + 1), lambda i: list_transform(range(i, n + 1), lambda j: CASE WHEN j - i + 1 < n THEN array_to_string(w[i:j], ' ') END))), lambda x: x IS NOT NULL)"""
_RANK = "row_number() OVER (PARTITION BY doc_id ORDER BY round({0}, 9) DESC, term DESC) AS rank"


def _counts(table) -> DataFrame:
    return terms.term_counts(terms.candidates(table("documents").select("doc_id", "text")))


@query(f"WITH {_CAND} SELECT * FROM cnt")
def term_counts(table):
    return _counts(table)


@query(rf"""WITH {_CAND},
s AS (SELECT doc_id, term AS o, unnest({_SUBS}) AS term FROM (SELECT *, regexp_extract_all(term, '\S+') AS w, len(regexp_extract_all(term, '\S+')) AS n FROM cnt)),
p AS (SELECT s.* FROM s JOIN cnt USING (doc_id, term)),
i AS (SELECT doc_id, term, count(*) AS k FROM p GROUP BY ALL), o AS (SELECT doc_id, o AS term, count(*) AS k FROM p GROUP BY ALL),
z AS (SELECT doc_id, term, cnt, coalesce(i.k, 0) AS contained_in, coalesce(o.k, 0) AS contains FROM cnt LEFT JOIN i USING (doc_id, term) LEFT JOIN o USING (doc_id, term)),
y AS (SELECT *, len(regexp_extract_all(term, '\S+')) * ln(cnt) + 0.75 * contained_in + 0.1 * contains AS score FROM z)
SELECT doc_id, term, cnt, contained_in, contains, round(score, 6) AS score, {_RANK.format('score')} FROM y""")
def combo_basic(table):
    return r6(terms.combo_basic(written(_counts(table), "counts")), "score")


_SUFFIX = f"""{_CAND},
u AS (SELECT doc_id, substring(term, instr(term, ' ') + 1) AS term, sum(cnt) AS s, max(cnt) AS m FROM cnt WHERE contains(term, ' ') GROUP BY 1, 2),
f AS (SELECT doc_id, term, cnt, CAST(CASE WHEN s IS NULL THEN 0 ELSE least(s, cnt) END AS BIGINT) AS suffix_count, m FROM cnt LEFT JOIN u USING (doc_id, term)),
g AS (SELECT doc_id, term, cnt, suffix_count, CASE WHEN suffix_count > 0 THEN least(m, suffix_count) / suffix_count ELSE 1.0 END AS suffix_factor FROM f)"""


@query(f"WITH {_SUFFIX} SELECT doc_id, term, cnt, suffix_count, round(suffix_factor, 6) AS suffix_factor FROM g")
def suffix_factors(table):
    return r6(terms.suffix_factors(written(_counts(table), "counts")), "suffix_factor")


@query(rf"""WITH {_SUFFIX}, y AS (SELECT *, cnt - suffix_count AS standalone, ln(0.1 + len(regexp_extract_all(term, '\S+'))) * (cnt - suffix_count + 0.5 * suffix_count * (1 - suffix_factor)) AS score FROM g)
SELECT doc_id, term, cnt, suffix_count, round(suffix_factor, 6) AS suffix_factor, round(score, 6) AS score, standalone, {_RANK.format('score')} FROM y""")
def c_value(table):
    return r6(terms.c_value(written(_counts(table), "counts")), "suffix_factor", "score")


@query(f"""WITH {_CAND}, df AS (SELECT term, count(*) AS df FROM cnt GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM cnt),
z AS (SELECT doc_id, term, cnt / sum(cnt) OVER (PARTITION BY doc_id) AS tf, df, cnt / sum(cnt) OVER (PARTITION BY doc_id) * ln(n / df) AS tf_idf FROM cnt JOIN df USING (term), n)
SELECT doc_id, term, round(tf, 6) AS tf, df, round(tf_idf, 6) AS tf_idf, {_RANK.format('tf_idf')} FROM z""")
def tf_idf(table):
    return r6(terms.tf_idf(written(_counts(table), "counts")), "tf", "tf_idf")


@query(f"WITH {_CAND} SELECT term, count(*) AS df FROM cnt GROUP BY term")
def doc_frequency(table):
    return terms.doc_frequency(_counts(table))


@query(f"WITH {_CAND} SELECT term, CAST(sum(cnt) AS BIGINT) AS cnt FROM cnt GROUP BY term HAVING sum(cnt) >= 2")
def corpus_counts(table):
    return terms.corpus_counts(_counts(table))


@query(f"WITH {_CAND}, l AS (SELECT DISTINCT description AS term FROM vectors) SELECT doc_id, term, cnt FROM cnt SEMI JOIN l USING (term) WHERE regexp_matches(term, '\\p{{L}}$')")
def listed_terms(table):
    return terms.ends_with_letter(terms.only_listed(_counts(table), table("vectors").select(F.col("description").alias("term"))))


@query(rf"SELECT p_partkey, unnest({_SUBS}) AS subterm FROM (SELECT p_partkey, regexp_extract_all(p_name, '\S+') AS w, len(regexp_extract_all(p_name, '\S+')) AS n FROM part)")
def subterms(table):
    return table("part").select("p_partkey", F.explode(T.subterms(F.col("p_name"))).alias("subterm"))


_TOK = "tok AS (SELECT DISTINCT * FROM idx_doc_token_info_recs WHERE token_i IS NOT NULL AND doc_id IS NOT NULL)"


@query(f"""WITH {_TOK}, c AS (SELECT lower(text) AS term, max(lower(lemma)) AS lemma, count(*) AS cnt FROM tok WHERE text IS NOT NULL AND lemma IS NOT NULL GROUP BY 1),
b AS (SELECT lemma, term AS rep FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY cnt DESC, term) AS rn FROM c) WHERE rn = 1)
SELECT lemma, term AS syn, rep FROM c JOIN b USING (lemma) WHERE term <> rep""")
def synonym_by_lemma(table):
    t = table("idx_doc_token_info_recs").distinct().where("token_i IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL AND lemma IS NOT NULL")
    return terms.synonyms_by_lemma(t.groupBy(F.lower("text").alias("term")).agg(F.max(F.lower("lemma")).alias("lemma"), F.count("*").alias("cnt")))


@query(f"""WITH {_TOK}, c AS (SELECT lower(text) AS word, CASE WHEN tag IN ('WP','NN','NNS','NNP','NNPS','PRP') THEN 'NOUN' WHEN tag IN ('JJ','JJR','JJS') THEN 'ADJ' WHEN tag IN ('MD','VB','VBD','VBG','VBN','VBP','VBZ') THEN 'VERB' ELSE 'OTHER' END AS category, count(*) AS cnt FROM tok WHERE text IS NOT NULL GROUP BY 1, 2)
SELECT word, category, cnt, row_number() OVER (PARTITION BY word ORDER BY cnt DESC, category) AS place FROM c""")
def category_counts(table):
    t = table("idx_doc_token_info_recs").distinct().where("token_i IS NOT NULL AND doc_id IS NOT NULL")
    z = terms.category_counts(t).select("word", F.posexplode("categories").alias("p", "c"))
    return z.select("word", "c.category", "c.cnt", (F.col("p") + 1).cast("long").alias("place"))


@query(f"WITH {_TOK} SELECT text, pos, arg_max(lemma, (doc_id, token_i)) AS lemma FROM tok WHERE lemma IS NOT NULL GROUP BY text, pos")
def word_lemmas(table):
    return terms.word_lemmas(table("idx_doc_token_info_recs").where("token_i IS NOT NULL AND doc_id IS NOT NULL"))


@query()
def rule_tokens(table):
    return rule_tokens_of(table("documents"))


@query()
def pattern_candidates(table):
    return terms.pattern_candidates(table("idx_doc_token_info_recs"))


@query()
def tagged_term_counts(table):
    return terms.tagged_term_counts(written(terms.pattern_candidates(table("idx_doc_token_info_recs")), "matches"))


_SENTS = r"""sents AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS sent_ind, unnest(p) AS text FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS p FROM documents WHERE text IS NOT NULL))"""


def _sentences(table) -> DataFrame:
    return table("documents").where("text IS NOT NULL").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sent_ind", "text"))


@query(f"WITH {_SENTS} SELECT doc_id, sent_ind, CAST(length(text) AS INTEGER) AS n FROM sents")
def sentences(table):
    return _sentences(table).select("doc_id", "sent_ind", F.length("text").alias("n"))


@query(f"WITH {_SENTS} SELECT DISTINCT description AS term, doc_id, sent_ind FROM sents JOIN vectors ON contains(lower(text), lower(description))")
def term_sentence_match(table):
    return terms.sentence_matches(_sentences(table), table("vectors").select(F.col("description").alias("term")))


@query(f"""WITH {_SENTS}, n AS (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id),
m AS (SELECT DISTINCT description AS term, doc_id, sent_ind FROM sents JOIN vectors ON contains(lower(text), lower(description)))
SELECT term, doc_id, CAST(unnest(range(greatest(0, sent_ind - 1), least(n - 1, sent_ind + 1) + 1)) AS INTEGER) AS sent_ind FROM m JOIN n USING (doc_id)""")
def context_band(table):
    s = _sentences(table)
    m = terms.sentence_matches(s, table("vectors").select(F.col("description").alias("term")))
    return terms.context_band(m, s.groupBy("doc_id").agg(F.count("*").cast("int").alias("n")), 1)


_ATTR = """last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, term_ind ORDER BY loaded_at DESC NULLS LAST, ATE_count DESC NULLS LAST, term DESC NULLS LAST) AS rn FROM attribute_rec) WHERE rn = 1),
attr AS (SELECT node_id, lower(trim(term)) AS term, CAST(max(ATE_count) AS BIGINT) AS cnt FROM last_ WHERE ATE_count IS NOT NULL AND trim(term) <> '' GROUP BY 1, 2)"""


def _last_attributes(table) -> DataFrame:
    a = table("attribute_rec")
    return a.groupBy("node_id", "term_ind").agg(F.max(F.struct("loaded_at", "ATE_count", "term", *[c for c in a.columns if c not in ("node_id", "term_ind", "loaded_at", "ATE_count", "term")])).alias("m")).select("node_id", "term_ind", "m.*")


def _attributes(table) -> DataFrame:
    a = _last_attributes(table).where("ATE_count IS NOT NULL AND trim(term) <> ''")
    return a.groupBy("node_id", F.lower(F.trim("term")).alias("term")).agg(F.max("ATE_count").cast("long").alias("cnt"))


_NODES = "nodes AS (SELECT DISTINCT * FROM segments)"


def _nodes(table) -> DataFrame:
    return table("segments").distinct()


@query(rf"""WITH {_ATTR}, {_NODES}, c AS (SELECT DISTINCT doc_id, term FROM attr JOIN nodes USING (node_id) WHERE doc_id IS NOT NULL),
p AS (SELECT DISTINCT term AS t1, t2 FROM (SELECT term, lead(term) OVER (PARTITION BY node_id ORDER BY term) AS t2 FROM attr JOIN (SELECT DISTINCT node_id FROM nodes WHERE doc_id IS NOT NULL) USING (node_id)) WHERE t2 IS NOT NULL),
s AS (SELECT term, list(DISTINCT CAST(doc_id AS VARCHAR)) AS l FROM c GROUP BY term)
SELECT t1, t2, round(1 - len(list_intersect(x.l, y.l)) / (len(x.l) + len(y.l) - len(list_intersect(x.l, y.l))), 6) AS distance FROM p JOIN s x ON x.term = t1 JOIN s y ON y.term = t2""")
def jaccard_context(table):
    """Each term of a node with the next in order, by the documents they occur in."""
    a = written(_attributes(table).join(_nodes(table).where("doc_id IS NOT NULL").select("node_id", "doc_id").distinct(), "node_id"), "attributes")
    c = a.select("term", F.col("doc_id").cast("string").alias("context_term")).distinct()
    nxt = a.select("node_id", "term").distinct().withColumn("t2", F.lead("term").over(W.partitionBy("node_id").orderBy("term")))
    pairs = nxt.where("t2 IS NOT NULL").select(F.col("term").alias("t1"), "t2").distinct()
    return r6(terms.jaccard_distance(c, pairs), "distance")


@query()
def disjoint_terms(table):
    return r6(terms.disjoint_terms(terms.combo_basic(written(_counts(table), "counts"))), "score", "total")


@query(f"""WITH {_ATTR}, t AS (SELECT DISTINCT term FROM attr)
SELECT a.term AS singular, b.term AS plural FROM t a JOIN t b ON b.term = a.term || 's' OR (a.term LIKE '%y' AND b.term = left(a.term, length(a.term) - 1) || 'ies')""")
def singular_plural(table):
    t = _attributes(table).select("term").distinct()
    forms = F.array_distinct(F.array_compact(F.array(F.concat("term", F.lit("s")), F.when(F.col("term").endswith("y"), F.regexp_replace("term", "y$", "ies")))))
    j = t.select(F.col("term").alias("singular"), F.explode(forms).alias("plural")).join(t.withColumnRenamed("term", "plural"), "plural")
    return j.where(T.singular_plural(F.col("singular"), F.col("plural"))).select("singular", "plural")


# --- text -----------------------------------------------------------------------------------------


@query(r"SELECT doc_id, md5(regexp_replace(lower(regexp_replace(text, '[^a-zA-z0-9]', ' ', 'g')), ' +', ' ', 'g')) AS h FROM documents")
def sanitize_sentence(table):
    return table("documents").select("doc_id", F.md5(T.sanitize_sentence(F.col("text"))).alias("h"))


@query(r"SELECT doc_id, lower(trim(regexp_replace(title, '[^a-zA-Z]+', ' ', 'g'))) AS term FROM documents")
def normalize_term(table):
    return table("documents").select("doc_id", T.normalize_term(F.col("title")).alias("term"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL")
def count_words(table):
    return table("documents").where("text IS NOT NULL").select("doc_id", T.count_words(F.col("text")).alias("n"))


@query()
def normalize_text_block(table):
    return table("documents").select("doc_id", T.normalize_text_block(F.col("text")).alias("text"))


@query(f"""WITH {_TOK}, e AS (SELECT doc_id, token_i, text, coalesce(sum(CASE WHEN regexp_matches(text, '[.!?]\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY token_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS par_num FROM tok)
SELECT doc_id, CAST(par_num AS BIGINT) AS par_num, min(token_i) AS first_pos, count(*) AS n, string_agg(coalesce(text, ''), '' ORDER BY token_i) AS block FROM e GROUP BY 1, 2""")
def paragraph_groups(table):
    t = table("idx_doc_token_info_recs").distinct().where("token_i IS NOT NULL AND doc_id IS NOT NULL")
    return grouping.grouped(grouping.paragraphs(t, "doc_id", pos="token_i"), "doc_id", "par_num", pos="token_i")


@query(f"WITH {_TOK} SELECT doc_id, sent_id, tag, min(token_i) AS first_pos, count(*) AS n, string_agg(coalesce(text, ''), '' ORDER BY token_i) AS block FROM tok GROUP BY 1, 2, 3")
def group_by_key_ordered(table):
    t = table("idx_doc_token_info_recs").distinct().where("token_i IS NOT NULL AND doc_id IS NOT NULL")
    return grouping.grouped(t, "doc_id", "sent_id", "tag", pos="token_i")


@query()
def chunk_until_length(table):
    p = table("documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return grouping.blocks_until_length(p, min_length=400)


@query(r"""WITH p AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS part, unnest(s) AS t FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
q AS (SELECT doc_id, part, t, CAST(unnest(range(0, greatest(length(t), 1), 2000)) AS INTEGER) AS a FROM p)
SELECT doc_id, part, CAST(a / 2000 AS INTEGER) AS piece, md5(substring(t, a + 1, 2000)) AS h FROM q""")
def text_blocks(table):
    return grouping.text_blocks(table("documents"), 2000).select("doc_id", "part", "piece", F.md5("block").alias("h"))


@query(f"""WITH {_TOK}, t AS (SELECT doc_id, sent_id, token_i, coalesce(text, '') AS text, coalesce(tag, '') AS tag, coalesce(dep, '') AS dep FROM tok WHERE sent_id IS NOT NULL),
a AS (SELECT doc_id, sent_id, sum(length(text) - length(replace(text, '.', ''))) AS periods, sum(CASE WHEN tag IN ('LS','$(','$,','SYM','X',':','HYPH') OR dep IN ('dep','list','meta','orphan') THEN 1 ELSE 0 END) AS formula,
  arg_max(tag, token_i) FILTER (lower(dep) = 'root') AS root, arg_max(text, token_i) AS last_text,
  arg_min(tag, token_i) FILTER (tag NOT IN ('SP','_SP','LS','$(','$,','SYM','X','EOL','SPACE',':','HYPH','NIL','ADD','NFP','XX','$.','ITJ') AND dep NOT IN ('punct','dep','advmod','intj','list','meta','orphan')) AS first_tag FROM t GROUP BY 1, 2)
SELECT doc_id, sent_id, CASE WHEN periods > 3 OR formula > 4 THEN 'formula' WHEN coalesce(root, '') NOT IN ('MD','VB','VBD','VBG','VBN','VBP','VBZ') THEN 'no_verb' WHEN last_text = '?' THEN 'question' WHEN coalesce(first_tag, '') IN ('MD','VB','VBD','VBG','VBN','VBP','VBZ') THEN 'imperative' ELSE 'valid' END AS verdict FROM a""")
def sentence_verdicts(table):
    return grouping.sentence_verdicts(table("idx_doc_token_info_recs").where("token_i IS NOT NULL AND doc_id IS NOT NULL"))


@query(SQL["sentence_verdicts"].replace("SELECT doc_id, sent_id, CASE WHEN periods", ", v AS (SELECT doc_id, sent_id, CASE WHEN periods").replace("AS verdict FROM a", "AS verdict FROM a), j AS (SELECT doc_id, sent_id, string_agg(text, ' ' ORDER BY token_i) AS text FROM tok WHERE sent_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2) SELECT doc_id, sent_id, trim(replace(text, chr(10), ' ')) AS text FROM j JOIN v USING (doc_id, sent_id) WHERE verdict = 'valid'"))
def valid_sentences(table):
    return grouping.valid_sentences(table("idx_doc_token_info_recs").where("token_i IS NOT NULL AND doc_id IS NOT NULL"))


# --- vectors --------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_LONG = "x AS (SELECT vec_id, label, CAST(generate_subscripts(v, 1) AS INTEGER) AS i, unnest(v) AS y FROM e)"
_MEAN = f"{_E}, {_LONG}, m AS (SELECT label, list(a ORDER BY i) AS mean FROM (SELECT label, i, avg(y) AS a FROM x GROUP BY 1, 2) GROUP BY label)"
_UNIT = f"{_MEAN}, um AS (SELECT label, list_transform(mean, lambda q: q / sqrt(list_dot_product(mean, mean))) AS u FROM m)"


@query(f"WITH {_UNIT} SELECT label, (SELECT count(*) FROM e WHERE e.label = um.label) AS n, CAST(generate_subscripts(u, 1) AS INTEGER) AS place, round(unnest(u), 6) AS value FROM um")
def vector_mean(table):
    m = vectors.group_means(table("embeddings"), "label", DIM)
    return m.select("label", "n", F.posexplode("mean").alias("p", "v")).select("label", "n", (F.col("p") + 1).alias("place"), F.round("v", 6).alias("value"))


@query(f"WITH {_E} SELECT round(min(list_dot_product(a.v, b.v)), 6) AS worst FROM e a, e b")
def global_worst_ip(table):
    return r6(vectors.worst_inner_product(table("embeddings")), "worst")


@query(f"""WITH {_E}, i AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS w FROM vectors),
p AS (SELECT e.vec_id, item_id, round(list_dot_product(v, w), 9) AS ip FROM e, i)
SELECT vec_id, item_id, round(ip, 6) AS ip FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ip DESC, item_id) AS rn FROM p) WHERE rn = 1""")
def nearest_item(table):
    return r6(vectors.nearest_item(table("embeddings"), table("vectors").select(F.col("vec_id").alias("item_id"), "embedding")), "ip")


@query(f"""WITH {_UNIT}, g AS (SELECT list(a ORDER BY i) AS gm FROM (SELECT i, avg(y) AS a FROM x GROUP BY 1)), gu AS (SELECT list_transform(gm, lambda q: q / sqrt(list_dot_product(gm, gm))) AS g FROM g),
s AS (SELECT e.label, vec_id, round((list_dot_product(v, u) + 1) / 2, 9) AS o, round((list_dot_product(v, g) + 1) / 2, 9) AS a FROM e JOIN um USING (label), gu),
o AS (SELECT label, vec_id AS exemplar_id, o AS exemplar_sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o DESC, vec_id) AS rn FROM s) WHERE rn = 1),
a AS (SELECT label, vec_id AS global_exemplar_id, a AS global_sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY a DESC, vec_id) AS rn FROM s) WHERE rn = 1)
SELECT CAST(o.label AS BIGINT) AS cluster_id, exemplar_id, round(exemplar_sim, 6) AS exemplar_sim, global_exemplar_id, round(global_sim, 6) AS global_sim, -1.0::DOUBLE AS parent_sim FROM o JOIN a USING (label)""")
def cluster_exemplars(table):
    m = table("embeddings").select(F.col("label").cast("long").alias("cluster_id"), "vec_id", "embedding")
    c = m.select("cluster_id", F.lit(None).cast("long").alias("parent_id")).distinct()
    return r6(vectors.exemplars(m, c, DIM), "exemplar_sim", "global_sim")


@query(f"""WITH {_UNIT}, p AS (SELECT vec_id, um.label AS l, round(list_dot_product(v, u), 9) AS ip FROM e, um WHERE e.label = 0 AND um.label <> 0)
SELECT vec_id, label FROM e WHERE label <> 0 UNION ALL SELECT vec_id, l AS label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ip DESC, l) AS rn FROM p) WHERE rn = 1""")
def noise_assignment(table):
    v = table("embeddings").withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return vectors.noise_assigned(v, DIM).select("vec_id", "label")


_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda k: ({0}[k] - {1}[k]) * ({0}[k] - {1}[k]))))"


@query(f"""WITH {_MEAN}, s AS (SELECT label, avg({_DIST.format('v', 'mean')}) AS s FROM e JOIN m USING (label) GROUP BY label),
r AS (SELECT a.label, max((sa.s + sb.s) / {_DIST.format('a.mean', 'b.mean')}) AS r FROM m a JOIN m b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY a.label)
SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def davies_bouldin(table):
    return r6(vectors.davies_bouldin(table("embeddings"), DIM), "davies_bouldin")


@query(f"""WITH {_MEAN}, g AS (SELECT list(a ORDER BY i) AS g FROM (SELECT i, avg(y) AS a FROM x GROUP BY 1)), n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
b AS (SELECT sum(n * {_DIST.format('mean', 'g')} ** 2) AS bss, count(*) AS k, sum(n) AS t FROM m JOIN n USING (label), g), w AS (SELECT sum({_DIST.format('v', 'mean')} ** 2) AS wss FROM e JOIN m USING (label))
SELECT round(bss * (t - k) / (wss * (k - 1)), 6) AS calinski_harabasz FROM b, w""")
def calinski_harabasz(table):
    return r6(vectors.calinski_harabasz(table("embeddings"), DIM), "calinski_harabasz")


@query(f"""WITH {_E}, d AS (SELECT a.vec_id, a.label, b.label AS ol, avg({_DIST.format('a.v', 'b.v')}) AS m FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(CASE WHEN label = ol THEN m END) AS a, min(CASE WHEN label <> ol THEN m END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def silhouette_euclid(table):
    return r6(vectors.silhouette(table("embeddings")), "silhouette")


@query(f"""WITH {_E}, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS w FROM vectors), p AS (SELECT query_id, vec_id, list_cosine_similarity(v, w) AS s FROM e, q),
r AS (SELECT query_id, vec_id, round(s, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM p) SELECT * FROM r WHERE rank <= 10""")
def most_similar(table):
    return vectors.most_similar(table("embeddings"), table("vectors"))


@query(f"""WITH {_E}, i AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS w, description FROM vectors),
p AS (SELECT e.vec_id, description, item_id, round(list_dot_product(v, w), 9) AS ip FROM e, i)
SELECT vec_id, description, round(ip, 6) AS ip FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ip DESC, item_id) AS rn FROM p) WHERE rn = 1""")
def described_by_items(table):
    return r6(vectors.described_by_items(table("embeddings"), table("vectors").select(F.col("vec_id").alias("item_id"), "embedding", "description")), "ip")


@query(f"WITH {_E}, i AS (SELECT vec_id AS b_id, CAST(embedding AS DOUBLE[]) AS w FROM vectors) SELECT vec_id AS a_id, b_id, round(list_dot_product(v, w), 6) AS ip FROM e, i WHERE round(list_dot_product(v, w), 9) >= 0.2")
def inner_products(table):
    return r6(vectors.inner_products(table("embeddings"), table("vectors"), least=0.2), "ip")


@query()
def close_communities(table):
    return vectors.close_communities(table("embeddings"), 0.4)


@query()
def density_clusters(table):
    return vectors.density_clusters(table("embeddings"), 0.35, 5)


@query()
def kmeans(table):
    return vectors.kmeans(table("embeddings"), 10)


@query()
def gmm(table):
    return vectors.gaussian_mixture(table("embeddings"), 5)


@query()
def bisecting(table):
    return vectors.agglomerative(table("embeddings"), 10)


@query()
def cluster_tree(table):
    clusters, members = vectors.cluster_tree(table("embeddings"), 4, DIM)
    return clusters.drop("mean").join(r6(vectors.tree_scores(members, clusters, DIM), "silhouette", "davies_bouldin", "calinski_harabasz"), "cluster_id", "left")


@query()
def pca_reconstruct(table):
    return vectors.pca_reduced(table("embeddings"), DIM)[0].select("vec_id", F.transform("reconstructed", lambda x: F.round(x, 6)).alias("reconstructed"))


@query()
def pca_split(table):
    return vectors.plus_minus_split(vectors.pca_reduced(table("embeddings"), DIM)[0])


@query()
def context_embeddings(table):
    t = table("vectors").select(F.col("description").alias("term"), "embedding")
    c = _attributes(table).join(table("cluster_rec").groupBy("cluster_id").agg(F.max_by("mean_vec", F.struct("loaded_at", "mean_vec")).alias("embedding")).where(F.size("embedding") == DIM).withColumnRenamed("cluster_id", "node_id"), "node_id").select("term", "embedding")
    return vectors.context_embeddings(t, c, DIM).select("term", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


_CLUSTERS = "c AS (SELECT DISTINCT cluster_id, parent_id FROM cluster_rec)"


def _clusters(table) -> DataFrame:
    return table("cluster_rec").select("cluster_id", "parent_id").distinct()


@query(f"""WITH RECURSIVE {_CLUSTERS}, p AS (SELECT cluster_id, [cluster_id] AS path, parent_id AS up FROM c UNION ALL SELECT p.cluster_id, list_append(p.path, c.cluster_id), c.parent_id FROM p JOIN c ON p.up = c.cluster_id)
SELECT cluster_id, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY len(path) DESC) AS rn FROM p) WHERE rn = 1""")
def cluster_paths(table):
    return vectors.cluster_paths(_clusters(table)).select("cluster_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"WITH {_CLUSTERS} SELECT cluster_id FROM c WHERE cluster_id NOT IN (SELECT parent_id FROM c WHERE parent_id IS NOT NULL)")
def cluster_leaves(table):
    return vectors.cluster_leaves(_clusters(table)).select("cluster_id")


# --- windows --------------------------------------------------------------------------------------

_POS = "s AS (SELECT label AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sent_ind, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _ordered(table) -> DataFrame:
    return table("embeddings").select(F.col("label").alias("doc_id"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("sent_ind"), "embedding")


_WSUM = f"""{_POS}, x AS (SELECT doc_id, sent_ind, CAST(generate_subscripts(v, 1) AS INTEGER) AS i, unnest(v) AS y FROM s),
w AS (SELECT doc_id, sent_ind, i, sum(y) OVER (PARTITION BY doc_id, i ORDER BY sent_ind ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS fwd, coalesce(sum(y) OVER (PARTITION BY doc_id, i ORDER BY sent_ind ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS back FROM x)"""


@query(f"WITH {_WSUM} SELECT doc_id, sent_ind, i AS place, round(fwd, 6) AS fwd, round(back, 6) AS back FROM w")
def window_sums(table):
    z = windows.window_sums(_ordered(table), 4, DIM).select("doc_id", "sent_ind", F.posexplode(F.arrays_zip("fwd", "back")).alias("p", "x"))
    return z.select("doc_id", "sent_ind", (F.col("p") + 1).alias("place"), F.round("x.fwd", 6).alias("fwd"), F.round("x.back", 6).alias("back"))


@query(f"WITH {_WSUM} SELECT doc_id, sent_ind, round((1 - sum(fwd * back) / 16) / 2, 6) AS distance FROM w GROUP BY 1, 2")
def topic_distance(table):
    return r6(windows.topic_distance(_ordered(table), 4, DIM), "distance")


_SERIES = "v AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, value FROM events)"


def _series(table) -> DataFrame:
    return table("events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("pos"), "value")


@query(f"""WITH {_SERIES} SELECT DISTINCT doc_id, first_value(pos) OVER (PARTITION BY doc_id ORDER BY value DESC, pos) AS max_pos, max(value) OVER (PARTITION BY doc_id) AS max_value,
first_value(pos) OVER (PARTITION BY doc_id ORDER BY value, pos) AS min_pos, min(value) OVER (PARTITION BY doc_id) AS min_value FROM v""")
def extrema(table):
    return windows.extrema(_series(table))


@query(f"""WITH {_SERIES}, z AS (SELECT doc_id, pos, avg(value) OVER (PARTITION BY doc_id) AS mean, count(*) OVER (PARTITION BY doc_id) AS n FROM v),
j AS (SELECT z.doc_id, z.pos AS ii, mean, n, v.pos, v.value FROM z JOIN v ON v.doc_id = z.doc_id AND v.pos BETWEEN z.pos AND z.pos + 7),
e AS (SELECT doc_id, ii, mean, n, max(value) AS hi, arg_max(pos, (value, -pos)) AS hp, arg_min(pos, (value, pos)) AS lp FROM j GROUP BY 1, 2, 3, 4)
SELECT DISTINCT doc_id, hp AS max_pos, lp AS min_pos FROM e WHERE ii < n - 8 AND abs(hp - ii - 4.0) < 1 AND hi >= mean""")
def window_extrema(table):
    return windows.window_extrema(_series(table), 8)


@query(SQL["window_extrema"].replace("SELECT DISTINCT doc_id, hp AS max_pos, lp AS min_pos", "SELECT DISTINCT doc_id, hp AS pos"))
def useful_extrema(table):
    return windows.useful_extrema(_series(table), 8)


@query(f"WITH {_SERIES}, a AS (SELECT doc_id, pos, avg(value) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS mean, count(*) OVER (PARTITION BY doc_id) AS n FROM v) SELECT doc_id, pos, round(mean, 6) AS mean FROM a WHERE pos <= n - 11")
def moving_average(table):
    return r6(windows.moving_average(_series(table), 11), "mean")


@query()
def extrema_counts(table):
    return windows.change_counts(_ordered(table))


@query()
def segment_tree(table):
    return segments.segment_tree(written(windows.change_counts(_ordered(table)), "changes"))


@query()
def node_means(table):
    v = written(_ordered(table), "ordered")
    tree = written(segments.segment_tree(windows.change_counts(v)), "tree")
    m = segments.node_means(tree, v, DIM)
    alt = segments.alternative_means(tree, m, DIM)
    return m.join(alt, ["doc_id", "node_id"]).select("doc_id", "node_id", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"), F.transform("alt_mean", lambda x: F.round(x, 6)).alias("alt_mean"))


# --- topic trees ----------------------------------------------------------------------------------

_CLOSURE = "above AS (SELECT n.doc_id, n.node_id, a.node_id AS ancestor FROM nodes n JOIN nodes a ON a.doc_id = n.doc_id AND a.start_at <= n.start_at AND n.end_at <= a.end_at AND a.level <= n.level AND (a.level < n.level OR a.node_id = n.node_id))"


@query(f"WITH {_NODES}, {_CLOSURE} SELECT * FROM above")
def segment_closure(table):
    return segments.span_closure(_nodes(table))


@query(f"WITH {_NODES} SELECT node_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_at, level, node_id) AS pre_order FROM nodes WHERE doc_id IS NOT NULL")
def segment_order(table):
    return segments.numbered(_nodes(table).where("doc_id IS NOT NULL")).select("node_id", "doc_id", "pre_order")


_ROLL = f"""{_ATTR}, {_NODES}, {_CLOSURE}, leaf AS (SELECT a.*, n.doc_id FROM attr a JOIN nodes n USING (node_id) WHERE n.doc_id IS NOT NULL AND n.node_id NOT IN (SELECT parent_node_id FROM nodes WHERE parent_node_id IS NOT NULL AND doc_id IS NOT NULL)),
r AS (SELECT leaf.doc_id, ancestor AS node_id, term, CAST(sum(cnt) AS BIGINT) AS cnt FROM leaf JOIN above USING (doc_id, node_id) GROUP BY 1, 2, 3)"""


def _rollup(table) -> DataFrame:
    n = written(_nodes(table).where("doc_id IS NOT NULL"), "nodes")
    c = _attributes(table).join(segments.leaves(n).select("doc_id", "node_id"), "node_id")
    return segments.rolled_up(c, segments.span_closure(n))


@query(f"WITH {_ROLL} SELECT doc_id, node_id, term, cnt, round(cnt / max(cnt) OVER (PARTITION BY doc_id, node_id), 6) AS scaled FROM r")
def segment_rollup(table):
    return r6(_rollup(table), "scaled")


@query(rf"""WITH {_ROLL}, s AS (SELECT term, unnest({_SUBS}) AS subterm FROM (SELECT term, regexp_extract_all(term, '\S+') AS w, len(regexp_extract_all(term, '\S+')) AS n FROM (SELECT DISTINCT term FROM r))),
h AS (SELECT doc_id, node_id, subterm AS term, count(*) AS extra, arg_min(cnt, term) AS f FROM r JOIN s USING (term) GROUP BY 1, 2, 3)
SELECT doc_id, node_id, term, coalesce(cnt, 0) AS cnt, CAST(coalesce(cnt, f) + coalesce(extra, 0) AS DOUBLE) AS augmented FROM r FULL JOIN h USING (doc_id, node_id, term)""")
def augmented_counts(table):
    c = written(_rollup(table).drop("scaled"), "rolled")
    sub = c.select("term").distinct().select("term", F.explode(T.subterms(F.col("term"))).alias("subterm"))
    return segments.augmented_counts(c, sub)


@query(f"""WITH {_ATTR}, {_NODES}, n AS (SELECT DISTINCT node_id, parent_node_id FROM nodes WHERE parent_node_id IS NOT NULL), c AS (SELECT * FROM attr JOIN n USING (node_id)),
d AS (SELECT parent_node_id, term, count(*) AS d FROM c GROUP BY 1, 2), z AS (SELECT parent_node_id, count(*) AS n FROM n GROUP BY 1)
SELECT node_id, term, round(cnt / max(cnt) OVER (PARTITION BY node_id) * ln(n / d), 6) AS tf_idf FROM c JOIN d USING (parent_node_id, term) JOIN z USING (parent_node_id)""")
def sibling_tf_idf(table):
    return r6(segments.sibling_tf_idf(_attributes(table), _nodes(table)), "tf_idf")


_RANKS = f"""{_ATTR}, a AS (SELECT node_id, term_ind, CASE WHEN isnan(sim_to_alt_mean) THEN NULL ELSE sim_to_alt_mean END AS s, ATE_count, tf_idf_rel_siblings AS t FROM last_ WHERE ATE_count > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY round(t * s, 9) DESC NULLS LAST, s DESC NULLS LAST, term_ind) AS rank_tf_idf FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY s DESC NULLS LAST, rank_tf_idf) AS rank_sim FROM b),
d AS (SELECT node_id, term_ind, rank_tf_idf, rank_sim, row_number() OVER (PARTITION BY node_id ORDER BY round(s * ln(ATE_count), 9) DESC NULLS LAST, rank_sim) AS rank_sim_count FROM c)"""


def _ranks(table) -> DataFrame:
    a = _last_attributes(table).where("ATE_count > 0").withColumn("sim_to_alt_mean", F.when(~F.isnan("sim_to_alt_mean"), F.col("sim_to_alt_mean")))
    return segments.attribute_ranks(a).select("node_id", "term_ind", "rank_tf_idf", "rank_sim", "rank_sim_count")


@query(f"WITH {_RANKS} SELECT * FROM d")
def attribute_ranks(table):
    return _ranks(table)


@query(f"WITH {_RANKS} SELECT node_id, term_ind, rank_sim FROM d WHERE rank_sim <= 10")
def top_terms(table):
    return segments.top_terms(_ranks(table)).select("node_id", "term_ind", "rank_sim")


@query(f"WITH {_NODES} SELECT n.node_id, n.doc_id, round((n.end_at - n.start_at + 1) / (p.end_at - p.start_at + 1), 4) AS share FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent_node_id")
def tree_lines(table):
    return segments.tree_lines(_nodes(table)).select("node_id", "doc_id", "share")


_MEANS = """lastc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY loaded_at DESC NULLS LAST, num_vectors DESC NULLS LAST) AS rn FROM cluster_rec) WHERE rn = 1),
cv AS (SELECT cluster_id AS node_id, CAST(mean_vec AS DOUBLE[]) AS v FROM lastc WHERE len(mean_vec) = 64 AND len(list_filter(mean_vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(mean_vec, lambda x: x <> 0)) > 0),
nm AS (SELECT node_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS mean FROM cv)"""


def _node_vectors(table) -> DataFrame:
    from corpusmill.functions.vectors import l2_normalize

    last = table("cluster_rec").groupBy("cluster_id").agg(F.max(F.struct("loaded_at", "num_vectors", "mean_vec")).alias("m"))
    v = F.col("v")
    ok = (F.size(v) == DIM) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return last.select(F.col("cluster_id").alias("node_id"), F.col("m.mean_vec").alias("v")).where(ok).select("node_id", l2_normalize(v).alias("mean"))


def _term_vectors(table) -> DataFrame:
    return table("vectors").select(F.col("description").alias("term"), "embedding")


@query(f"WITH {_ATTR}, {_MEANS}, t AS (SELECT description AS term, CAST(embedding AS DOUBLE[]) AS e FROM vectors) SELECT node_id, term, round((list_dot_product(e, mean) + 1) / 2, 4) AS sim_to_mean FROM attr JOIN nm USING (node_id) JOIN t USING (term)")
def term_similarities(table):
    return segments.term_similarities(_attributes(table).select("node_id", "term"), _node_vectors(table), _term_vectors(table))


@query(f"""WITH {_ATTR}, {_MEANS}, {_NODES}, t AS (SELECT description AS term, CAST(embedding AS DOUBLE[]) AS e FROM vectors), up AS (SELECT DISTINCT node_id, parent_node_id FROM nodes WHERE parent_node_id IS NOT NULL)
SELECT a.node_id, term, round((list_dot_product(e, mean) + 1) / 2, 4) AS sim_to_parent FROM attr a JOIN up ON up.node_id = a.node_id JOIN nm ON nm.node_id = up.parent_node_id JOIN t USING (term)""")
def parent_similarities(table):
    return segments.parent_similarities(_attributes(table).select("node_id", "term"), _nodes(table), _node_vectors(table), _term_vectors(table))


# --- wiki pages -----------------------------------------------------------------------------------


def _pages(table) -> DataFrame:
    return table("documents").where("text IS NOT NULL").select(F.col("doc_id").alias("page_id"), F.lit("0").alias("ns"), "title", "text")


_LINKS = r"""l0 AS (SELECT doc_id AS page_id, title, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, string_split(unnest(m), '|') AS p FROM (SELECT doc_id, title, regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1) AS m FROM documents WHERE text IS NOT NULL)),
links AS (SELECT page_id, title, pos, trim(p[1]) AS target, trim(coalesce(p[2], p[1])) AS anchor FROM l0)"""


@query(f"WITH {_LINKS} SELECT page_id, pos, target, anchor FROM links")
def wiki_links(table):
    return wiki.links(_pages(table))


@query(f"WITH {_LINKS} SELECT target, count(*) AS cnt FROM links WHERE title IS NOT NULL AND NOT starts_with(target, 'Category:') GROUP BY target")
def link_counts(table):
    return wiki.link_graph(_pages(table))["link_counts"]


@query(f"WITH {_LINKS} SELECT anchor, target, count(*) AS cnt FROM links WHERE title IS NOT NULL AND NOT starts_with(target, 'Category:') GROUP BY 1, 2")
def link_text_to_target(table):
    return wiki.link_graph(_pages(table))["text_counts"]


@query("SELECT DISTINCT title FROM documents WHERE title IS NOT NULL AND text IS NOT NULL")
def article_titles(table):
    return wiki.link_graph(_pages(table))["titles"]


_WTOK = r"wt AS (SELECT doc_id AS page_id, title, list_filter(regexp_extract_all(lower(text), '[\p{L}]+'), lambda x: length(x) BETWEEN 2 AND 15) AS tokens FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_WTOK} SELECT page_id, CAST(len(tokens) AS INTEGER) AS n FROM wt WHERE len(tokens) >= 50 AND NOT regexp_matches(title, '^({'|'.join(wiki.IGNORED_PREFIXES)}):')")
def title_prune(table):
    t = _pages(table).select("page_id", "title", F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)), lambda x: F.length(x).between(2, 15)).alias("tokens"))
    return wiki.articles(t).select("page_id", F.size("tokens").alias("n"))


@query()
def wiki_clean(table):
    return wiki.cleaned(_pages(table)).select("page_id", "text")


@query()
def wiki_sections(table):
    return wiki.sections(_pages(table))


@query()
def wiki_chunks(table):
    return wiki.chunks(wiki.sections(_pages(table)), 500).select("page_id", "tag", "chunk")


@query()
def wiki_corpus(table):
    return wiki.corpus(_pages(table), by_section=True, min_tokens=5)


@query()
def wiki_vocabulary(table):
    return wiki.vocabulary(wiki.corpus(_pages(table), min_tokens=5))


@query(f"WITH {_WTOK} SELECT count(*) AS articles, count(*) AS chunks, CAST(sum(len(tokens)) AS BIGINT) AS positions FROM wt WHERE len(tokens) >= 50 AND NOT regexp_matches(title, '^({'|'.join(wiki.IGNORED_PREFIXES)}):')")
def corpus_counters(table):
    t = _pages(table).select("page_id", "title", F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)), lambda x: F.length(x).between(2, 15)).alias("tokens"))
    return wiki.counters(wiki.articles(t))


@query()
def word2vec_docs(table):
    c = written(wiki.corpus(_pages(table), min_tokens=5), "corpus")
    return wiki.document_vectors(wiki.word_vectors(c), c)


# --- sentence graphs ------------------------------------------------------------------------------

_WORDS = f"""{_TOK}, w0 AS (SELECT doc_id, sent_id, token_i, any_value(text) AS text, any_value(lemma) AS lemma, any_value(tag) AS tag, any_value(dep) AS dep, any_value(head_i) AS head_i FROM tok GROUP BY 1, 2, 3),
w1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY token_i) AS word_id FROM w0),
words AS (SELECT a.doc_id, a.sent_id, a.word_id, coalesce(b.word_id, 0) AS head_id, a.token_i, a.text, a.lemma, a.tag, a.dep FROM w1 a LEFT JOIN w1 b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.head_i = b.token_i)"""


def _words(table) -> DataFrame:
    return sentence_graph.words_of(table("idx_doc_token_info_recs").where("doc_id IS NOT NULL"))


@query(f"WITH {_WORDS} SELECT doc_id, sent_id, word_id, head_id, token_i, tag, dep FROM words")
def sentence_words(table):
    return _words(table).drop("text", "lemma")


@query(f"WITH {_WORDS} SELECT doc_id, sent_id || '.' || head_id AS src, sent_id || '.' || word_id AS dst, tag || ':' || dep AS kind FROM words WHERE head_id <> 0 UNION ALL SELECT doc_id, sent_id || '.' || word_id, sent_id || '.' || head_id, 'CONJ' FROM words WHERE head_id <> 0 AND dep = 'conj'")
def dependency_edges(table):
    return sentence_graph.dependency_edges(_words(table)).drop("extra")


@query(f"WITH {_WORDS} SELECT doc_id, sent_id || '.' || (word_id - 1) AS src, sent_id || '.' || word_id AS dst FROM words WHERE word_id > 1")
def word_order_edges(table):
    return sentence_graph.word_order_edges(_words(table)).select("doc_id", "src", "dst")


@query(f"WITH {_WORDS}, n AS (SELECT doc_id, lemma, token_i FROM words WHERE tag IN ('NN','NNS','NNP','NNPS') AND lemma IS NOT NULL) SELECT x.doc_id, x.token_i AS a, y.token_i AS b FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.lemma = y.lemma AND x.token_i < y.token_i")
def identical_noun_pairs(table):
    return sentence_graph.identical_noun_pairs(_words(table))


@query(f"""WITH {_WORDS}, n AS (SELECT doc_id, sent_id || '.' || word_id AS u, lead(sent_id || '.' || word_id) OVER (PARTITION BY doc_id, lemma ORDER BY sent_id, word_id) AS v FROM words WHERE tag IN ('NN','NNS','NNP','NNPS') AND lemma IS NOT NULL)
SELECT doc_id, u AS src, v AS dst, 'identical_nouns' AS kind, 'noun' AS extra FROM n WHERE v IS NOT NULL UNION ALL SELECT doc_id, v, u, 'identical_nouns', 'noun' FROM n WHERE v IS NOT NULL""")
def identical_noun_edges(table):
    return sentence_graph.identical_noun_edges(_words(table))


def _runs_sql(member: str) -> str:
    return f"""WITH {_WORDS}, m AS (SELECT *, word_id - row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY word_id) AS g FROM words WHERE {member})
SELECT doc_id, sent_id, min(token_i) AS first_i, max(token_i) AS last_i, count(*) AS n, string_agg(text, ' ' ORDER BY token_i) AS text FROM m GROUP BY doc_id, sent_id, g HAVING count(*) > 1"""


@query(_runs_sql("tag IN ('MD','VB','VBD','VBG','VBN','VBP','VBZ') AND coalesce(dep, '') <> 'amod'"))
def verb_runs(table):
    return sentence_graph.verb_runs(table("idx_doc_token_info_recs"))


@query(_runs_sql("starts_with(tag, 'JJ') OR dep = 'amod'"))
def adjective_runs(table):
    return sentence_graph.adjective_runs(table("idx_doc_token_info_recs"))


@query(_runs_sql("tag = 'IN'"))
def preposition_runs(table):
    return sentence_graph.preposition_runs(table("idx_doc_token_info_recs"))


@query(_runs_sql("tag IN ('NN','NNS','NNP','NNPS')"))
def noun_runs(table):
    return sentence_graph.noun_runs(table("idx_doc_token_info_recs"))


@query(f"WITH {_WORDS} SELECT doc_id, sent_id, head_id, array_to_string(list(word_id ORDER BY word_id), ',') AS children FROM words GROUP BY 1, 2, 3")
def dependency_children(table):
    return sentence_graph.dependency_children(_words(table)).withColumn("children", F.array_join(F.transform("children", lambda x: x.cast("string")), ","))


@query(f"WITH {_TOK} SELECT doc_id, token_i, CAST(coalesce(sum(CASE WHEN text = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY token_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS sent_id FROM tok")
def sentence_starts(table):
    t = table("idx_doc_token_info_recs").distinct().where("token_i IS NOT NULL AND doc_id IS NOT NULL")
    return sentence_graph.sentence_starts(t, ".").select("doc_id", "token_i", "sent_id")


def _tree(table) -> DataFrame:
    """A tree of two levels over each sentence's words: a clause, below it a phrase for each word by its class of tag,
    with the word as its only child."""
    w = _words(table).where("sent_id IS NOT NULL").select("doc_id", "sent_id", "word_id", "tag")
    label = F.when(F.col("tag").isin(*NOUN_TAGS), "NP").when(F.col("tag").isin(*VERB_TAGS), "VP").when(F.col("tag") == "IN", "PP").otherwise("X")
    kinds = F.array(F.struct((F.col("word_id") * 2 - 1).alias("node"), F.lit(0).cast("long").alias("parent"), F.col("word_id").cast("int").alias("child_pos"), label.alias("label"), F.lit(None).cast("long").alias("word")),
                    F.struct((F.col("word_id") * 2).alias("node"), (F.col("word_id") * 2 - 1).alias("parent"), F.lit(0).alias("child_pos"), F.coalesce("tag", F.lit("")).alias("label"), F.col("word_id").alias("word")))
    low = w.select("doc_id", "sent_id", F.explode(kinds).alias("k")).select("doc_id", "sent_id", "k.node", "k.parent", "k.child_pos", "k.label", F.col("k.word").alias("word_id"))
    top = w.select("doc_id", "sent_id").distinct().select("doc_id", "sent_id", F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("child_pos"), F.lit("S").alias("label"), F.lit(None).cast("long").alias("word_id"))
    return written(sentence_graph.numbered_tree(top.union(low)), "tree")


_NOUNS, _VERBS = (", ".join(f"'{t}'" for t in tags) for tags in (NOUN_TAGS, VERB_TAGS))
_SUBJ = ", ".join(f"'{t}'" for t in SUBJECTS)
_UID = lambda no: f"sent_id || '-' || lpad(CAST({no} AS VARCHAR), 6, '0')"
_TREE = f"""{_WORDS}, sw AS (SELECT * FROM words WHERE sent_id IS NOT NULL),
tree AS (
  SELECT doc_id, sent_id, {_UID("0")} AS uid, NULL AS parent_uid, 'S' AS label, 0 AS level, NULL AS word_id FROM sw GROUP BY doc_id, sent_id
  UNION ALL SELECT doc_id, sent_id, {_UID("2 * word_id - 1")}, {_UID("0")}, CASE WHEN tag IN ({_NOUNS}) THEN 'NP' WHEN tag IN ({_VERBS}) THEN 'VP' WHEN tag = 'IN' THEN 'PP' ELSE 'X' END, 1, NULL FROM sw
  UNION ALL SELECT doc_id, sent_id, {_UID("2 * word_id")}, {_UID("2 * word_id - 1")}, coalesce(tag, ''), 2, word_id FROM sw),
cover AS (
  SELECT doc_id, sent_id, {_UID("0")} AS uid, word_id, head_id, dep, text FROM sw
  UNION ALL SELECT doc_id, sent_id, {_UID("2 * word_id - 1")}, word_id, head_id, dep, text FROM sw
  UNION ALL SELECT doc_id, sent_id, {_UID("2 * word_id")}, word_id, head_id, dep, text FROM sw),
open_ AS (SELECT DISTINCT c.doc_id, c.sent_id, c.uid, c.head_id, c.dep FROM cover c WHERE NOT EXISTS (SELECT 1 FROM cover d WHERE d.doc_id = c.doc_id AND d.sent_id = c.sent_id AND d.uid = c.uid AND d.word_id = c.head_id))"""


@query(f"WITH {_TREE} SELECT doc_id, sent_id, uid, parent_uid, label, level, word_id, {_UID('0')} AS subsentence_uid FROM tree")
def numbered_tree(table):
    return _tree(table).drop("child_pos", "size")


@query(f"WITH {_TREE} SELECT doc_id, sent_id, uid, word_id FROM cover")
def covered_words(table):
    return sentence_graph.covered_words(_tree(table))


@query(f"WITH {_TREE} SELECT doc_id, sent_id, uid, string_agg(text, ' ' ORDER BY word_id) AS text FROM cover WHERE text IS NOT NULL GROUP BY doc_id, sent_id, uid")
def tree_text(table):
    return sentence_graph.tree_text(_tree(table), _words(table).where("text IS NOT NULL"))


@query(f"WITH {_TREE} SELECT * FROM open_")
def unresolved_heads(table):
    return sentence_graph.unresolved_heads(_tree(table), _words(table))


@query(f"WITH {_TREE} SELECT doc_id, sent_id, head_id, dep, min(uid) AS uid FROM open_ GROUP BY doc_id, sent_id, head_id, dep")
def highest_nodes(table):
    return sentence_graph.highest_nodes(sentence_graph.unresolved_heads(_tree(table), _words(table)))


@query(f"""WITH {_TREE} SELECT t.doc_id, t.sent_id, t.uid, t.level, t.label, t.word_id, CASE WHEN t.word_id IS NULL THEN t.label
ELSE w.text || ' (' || coalesce(w.tag, '') || '/' || coalesce(w.dep, '') || ')' || CASE WHEN w.lemma IS NOT NULL AND lower(w.lemma) <> lower(w.text) THEN chr(10) || w.lemma ELSE '' END END AS node_label
FROM tree t LEFT JOIN sw w ON t.doc_id = w.doc_id AND t.sent_id = w.sent_id AND t.word_id = w.word_id""")
def word_nodes(table):
    return sentence_graph.word_nodes(_tree(table), _words(table))


_NOUNISH = f"(tag IN ('WHNP', 'WP', 'NP', {_NOUNS}, 'PRP') OR coalesce(dep, '') IN ('nsubj', 'nsubj:pass'))"
_VERBISH = f"(tag IN ('VP', {_VERBS}) AND tag <> 'MD' AND coalesce(dep, '') <> 'amod')"
_ADJISH = "(tag IN ('ADJP', 'JJ', 'JJR', 'JJS') OR coalesce(dep, '') = 'amod')"


@query(f"""WITH {_TREE}, r AS (SELECT doc_id, sent_id, {_UID('2 * word_id')} AS uid, CASE WHEN head_id = 0 AND {_NOUNISH} THEN 'main_noun' WHEN head_id = 0 AND {_VERBISH} THEN 'main_verb' WHEN head_id = 0 AND {_ADJISH} THEN 'main_adjective'
WHEN head_id = 0 THEN 'root' WHEN dep IN ({_SUBJ}) THEN 'subject' WHEN {_NOUNISH} THEN 'noun' WHEN {_VERBISH} THEN 'verb' WHEN {_ADJISH} THEN 'adjective' END AS role FROM sw) SELECT * FROM r WHERE role IS NOT NULL""")
def node_roles(table):
    return sentence_graph.node_roles(_tree(table), _words(table))


@query(f"WITH {_TREE} SELECT doc_id, sent_id, parent_uid AS src, uid AS dst, 'parent' AS kind FROM tree WHERE parent_uid IS NOT NULL")
def tree_edges(table):
    return sentence_graph.tree_edges(_tree(table))


@query(f"""WITH {_WORDS} SELECT s.doc_id, s.sent_id, s.word_id AS src, s.head_id AS dst, 'COPULA relationship' AS kind FROM words s JOIN words c
ON s.doc_id = c.doc_id AND s.sent_id = c.sent_id AND s.head_id = c.head_id AND c.dep = 'cop' WHERE s.dep IN ('nsubj', 'csubj')""")
def copula_edges(table):
    return sentence_graph.copula_edges(_words(table))


@query()
def retokenize(table):
    return sentence_graph.retokenized(table("idx_doc_token_info_recs"))


@query()
def relative_resolutions(table):
    return sentence_graph.relative_resolutions(_words(table))


@query()
def sentence_graph_dot(table):
    return sentence_graph.dot_text(*sentence_graph.sentence_graph(written(_words(table), "words"), _tree(table)))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT node_id AS a, parent_node_id AS b FROM segments WHERE node_id IS NOT NULL AND parent_node_id IS NOT NULL),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def connected_components(table):
    return graph.connected_components(table("segments").select(F.col("node_id").alias("a"), F.col("parent_node_id").alias("b")))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
