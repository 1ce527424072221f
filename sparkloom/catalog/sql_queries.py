"""The SQL front-end. Each text also runs as the oracle's."""

from ..operators import where
from ..sources import table
from ..sql import SqlContext
from .registry import query


def _run(spark, sf_dir, text, *names):
    context = SqlContext(spark)
    for name in names:
        context.register(name, table(spark, sf_dir, name))
    return context.query(text)


STAR = "SELECT * FROM nation"
WHERE = "SELECT s_suppkey, s_name AS supplier FROM supplier WHERE s_acctbal > 0 AND NOT s_nationkey = 3"
GROUPED = "SELECT c_mktsegment, COUNT(*) AS customers, MIN(c_acctbal) AS low FROM customer GROUP BY c_mktsegment HAVING COUNT(*) > 100 ORDER BY c_mktsegment"
JOINED = "SELECT n_name, r_name FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey WHERE r_name <> 'ASIA'"
GLOBAL = "SELECT COUNT(*) AS n, MIN(p_size) AS low, MAX(p_size) AS high, AVG(p_size) AS mean FROM part"
LITERALS = "SELECT r_regionkey, NULL IS NULL AS yes, TRUE AND NOT FALSE AS also, -3 * (2 + 1) AS number FROM region WHERE (r_name IS NOT NULL) = TRUE"
CASES = "select N_NATIONKEY as n_nationkey, n_name As name From nation wHeRe n_regionkey >= 2"
COMMENT = "SELECT r_regionkey, 'it''s ' || r_name AS label -- a comment\nFROM region WHERE r_name != 'it''s'"
GROUP_ONLY = "SELECT c_nationkey FROM customer GROUP BY c_nationkey"


@query(STAR)
def sql_select_star(spark, sf_dir):
    return _run(spark, sf_dir, STAR, "nation")


@query(WHERE)
def sql_select_where(spark, sf_dir):
    return _run(spark, sf_dir, WHERE, "supplier")


@query(GROUPED)
def sql_group_having_order(spark, sf_dir):
    return _run(spark, sf_dir, GROUPED, "customer")


@query(JOINED)
def sql_join_on(spark, sf_dir):
    return _run(spark, sf_dir, JOINED, "nation", "region")


@query(GLOBAL)
def sql_global_agg(spark, sf_dir):
    return _run(spark, sf_dir, GLOBAL, "part")


@query(LITERALS)
def sql_null_literals(spark, sf_dir):
    return _run(spark, sf_dir, LITERALS, "region")


@query(CASES)
def sql_case_insensitive_keywords(spark, sf_dir):
    return _run(spark, sf_dir, CASES, "nation")


@query(COMMENT)
def sql_comment_and_escape(spark, sf_dir):
    return _run(spark, sf_dir, COMMENT, "region")


@query(GROUP_ONLY)
def sql_group_only(spark, sf_dir):
    return _run(spark, sf_dir, GROUP_ONLY, "customer")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def sql_view_replace(spark, sf_dir):
    context = SqlContext(spark)
    context.register("places", table(spark, sf_dir, "region"))
    context.register("places", where(table(spark, sf_dir, "nation"), "n_regionkey = 2"))
    return context.query("SELECT n_name FROM places")
