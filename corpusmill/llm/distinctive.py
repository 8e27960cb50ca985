"""How characteristic a term is of its record against the whole collection.

Log-odds ratio of the record against the rest, with an informative Dirichlet prior proportional to
the collection's counts, divided by its standard error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.records import COUNTING_SQL, counting_rows
from corpusmill.plans.lineage import written
from corpusmill.plans.skew import hot_keys, salted_join

#: Weight of the prior, in occurrences.
PRIOR = 1000.0


def log_odds(rec: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row per node and term of the rows that count: cnt, node_total, term_total, term_nodes,
    total, log_odds, z_score.

    With c = cnt, a = prior * term_total / total, the log-odds of the node is
    ln((c + a) / (node_total + prior - c - a)), that of the rest likewise from what the node leaves;
    their difference over sqrt(1/(c + a) + 1/(rest + a)) is z_score. Several rows of one term in a
    node are summed. Where the collection has one term only, the odds have no value: log_odds and
    z_score are null. No rows in, no rows out.

    Hot terms or nodes are salted in the two joins; their list is bounded by the share that makes
    a key hot.
    """
    pairs = written(counting_rows(rec).groupBy("node_id", "term").agg(F.sum("cnt").alias("cnt")), "pairs")
    terms = written(pairs.groupBy("term").agg(F.sum("cnt").alias("term_total"), F.count("*").alias("term_nodes")), "terms")
    nodes = written(pairs.groupBy("node_id").agg(F.sum("cnt").alias("node_total"), F.count("*").alias("n")), "nodes")
    total = terms.agg(F.sum("term_total").alias("total"))  # one row
    out = salted_join(pairs, nodes.drop("n"), "node_id", hot_keys(nodes, "node_id", "n"))
    out = salted_join(out, terms, "term", hot_keys(terms, "term", "term_nodes")).crossJoin(F.broadcast(total))
    c, n, w, t, p = (F.col(x).cast("double") for x in ("cnt", "node_total", "term_total", "total", "_p"))
    out = out.withColumn("_p", F.lit(float(prior))).withColumn("_a", p * w / t)
    a = F.col("_a")
    here, rest = c + a, w - c + a
    odds_here, odds_rest = n + p - here, t - n + p - rest
    out = out.withColumn("log_odds", F.when((odds_here > 1e-9) & (odds_rest > 1e-9), F.ln(here / odds_here) - F.ln(rest / odds_rest)))
    return out.withColumn("z_score", F.col("log_odds") / F.sqrt(1 / here + 1 / rest)).drop("_p", "_a").select(
        "node_id", "term", "cnt", "node_total", "term_total", "term_nodes", "total", "log_odds", "z_score"
    )


def characteristic(rec: DataFrame, times: int = 20, least: int = 4, nodes: int = 2) -> DataFrame:
    """(node_id, term) of log_odds() above zero whose share of the node is at least `times` that of
    the table, with at least `least` occurrences in the node and at least `nodes` nodes.

    A share above the table's always has positive log-odds, so the first test loses none."""
    z = log_odds(rec)
    return z.where(
        (F.col("z_score") > 0) & (F.col("cnt") >= least) & (F.col("term_nodes") >= nodes)
        & (F.col("cnt").cast("decimal(38,0)") * F.col("total") >= F.col("term_total").cast("decimal(38,0)") * F.col("node_total") * times)
    ).select("node_id", "term")


_SCORED = f"""WITH {COUNTING_SQL},
pairs AS (SELECT node_id, term, CAST(sum(cnt) AS BIGINT) AS cnt FROM rows_ GROUP BY node_id, term),
full_ AS (
  SELECT *, CAST(sum(cnt) OVER (PARTITION BY node_id) AS BIGINT) AS node_total, CAST(sum(cnt) OVER (PARTITION BY term) AS BIGINT) AS term_total,
         count(*) OVER (PARTITION BY term) AS term_nodes, CAST(sum(cnt) OVER () AS BIGINT) AS total FROM pairs),
z AS (SELECT *, {PRIOR} * term_total / total AS a FROM full_)
"""

SQL = {
    "p1_log_odds": _SCORED + f"""
SELECT node_id, term, cnt, node_total, term_total, term_nodes, total,
       round(ln((cnt + a) / (node_total + {PRIOR} - cnt - a)) - ln((term_total - cnt + a) / (total - node_total + {PRIOR} - term_total + cnt - a)), 6) AS log_odds,
       round((ln((cnt + a) / (node_total + {PRIOR} - cnt - a)) - ln((term_total - cnt + a) / (total - node_total + {PRIOR} - term_total + cnt - a)))
             / sqrt(1 / (cnt + a) + 1 / (term_total - cnt + a)), 6) AS z_score
FROM z""",
    "p1_found": _SCORED + """
SELECT node_id, term FROM z
WHERE cnt >= 4 AND term_nodes >= 2 AND CAST(cnt AS HUGEINT) * total >= CAST(20 AS HUGEINT) * term_total * node_total""",
}


def p1_log_odds(spark, d):
    return log_odds(spark.read.parquet(f"{d}/attribute_rec.parquet")).withColumns({c: F.round(c, 6) for c in ("log_odds", "z_score")})


def p1_found(spark, d):
    return characteristic(spark.read.parquet(f"{d}/attribute_rec.parquet"))


QUERIES = {"p1_log_odds": p1_log_odds, "p1_found": p1_found}
