"""Layout jobs, page analytics and streaming feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.operators import access, gather, layout, ordering, sets
from nodeloom.plans.store import fresh_path, materialize
from nodeloom.streaming import feeds
from queries import fixtures as fx
from queries.fixtures import PER_BATCH, feat_digest, feat_digest_sql, sql
from queries.relational import _CUT, _LAYOUT, _cut_groups, _layout

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            SQL[fn.__name__] = oracle
        return fn

    return register


_RANKED = ("SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY s.score DESC, e.dst) - 1 AS npos FROM edges e JOIN scores s ON s.node_id = e.dst")


def _ranked(spark, sf):
    return layout.rank_neighbors(fx.edges(spark, sf), fx.scores(spark, sf))


@query(sql(_RANKED, "edges", "scores"))
def rank_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf)


@query(sql("SELECT src, npos // 4 AS g, npos % 4 AS slot, dst AS node_id FROM r WHERE npos < 8 AND npos // 4 < (SELECT 1) * len // 4",
           "edges", "scores", r=_RANKED.replace("SELECT e.src", "SELECT count(*) OVER (PARTITION BY e.src) AS len, e.src")))
def chunk_groups(spark, sf):
    return layout.chunk_groups(_ranked(spark, sf), 4, 2)


def _self_adj(spark, sf):
    looped = sets.add_self_loops(fx.edges(spark, sf), fx.ids(spark, sf))
    return materialize(layout.neighbor_order(looped), "adj")


_LOOPED = "SELECT src, dst FROM edges UNION SELECT node_id, node_id FROM ids"


def _walk_ctes(adj: str, order: str, k: int, cap: int, exclusive: bool) -> dict[str, str]:
    """The greedy walk, one source a step, as a recursive query: ``adj`` is (src, nb list), ``order`` is (src, rn from 1)."""
    skip = "NOT list_contains(w.used, a.src)" if exclusive else "true"
    free = "list_filter(a.nb, lambda x: NOT list_contains(w.used, x))"
    return {
        "steps": f"SELECT o.rn, o.src, coalesce(a.nb, []::BIGINT[]) AS nb FROM ({order}) o LEFT JOIN ({adj}) a USING (src)",
        "walk": "@walk(rn, used, src, took) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, []::BIGINT[] UNION ALL "
                "SELECT t.rn, list_concat(t.used, t.took), t.src, t.took FROM ("
                f"SELECT a.rn, w.used, a.src, CASE WHEN {skip} THEN {free}[1:{k} * least({cap}, len({free}) // {k})] ELSE []::BIGINT[] END AS took "
                "FROM walk w JOIN steps a ON a.rn = w.rn + 1) t)",
        "wrows": f"SELECT w.rn, w.src, (u.i - 1) // {k} AS g, (u.i - 1) % {k} AS slot, w.took[u.i] AS node_id FROM walk w, unnest(range(1, len(w.took) + 1)) AS u(i)",
        "groups": "SELECT CAST(dense_rank() OVER (ORDER BY rn, g) - 1 AS BIGINT) AS group_id, src, CAST(slot AS BIGINT) AS slot, node_id FROM wrows",
    }


def _order_sql(edges: str, direction: str) -> str:
    return ("SELECT s.node_id AS src, row_number() OVER (ORDER BY coalesce(d.n, 0) " + direction + ", s.score DESC, s.node_id) AS rn FROM scores s "
            f"LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM ({edges}) GROUP BY src) d ON d.src = s.node_id")


_WALK = _walk_ctes(f"SELECT src, list(dst ORDER BY dst = src, dst) AS nb FROM ({_LOOPED}) GROUP BY src", _order_sql(_LOOPED, "ASC"), 4, 1, True)
_WALK_MULTI = _walk_ctes(f"SELECT src, list(dst ORDER BY npos) AS nb FROM ({_RANKED}) GROUP BY src", _order_sql("SELECT src, dst FROM edges", "DESC"), 4, 5, False)


def _first_groups(spark, sf, adj, k=4):
    order = layout.degree_order(adj, fx.ids(spark, sf), fx.scores(spark, sf), "degree_asc")
    return layout.group_neighbors(adj, order, k)


@query(sql("SELECT * FROM groups", "ids", "edges", "scores", recursive=True, **_WALK))
def group_neighbors(spark, sf):
    return layout.uniform_groups(_first_groups(spark, sf, _self_adj(spark, sf)))


@query(sql("SELECT * FROM groups", "edges", "scores", recursive=True, **_WALK_MULTI))
def group_neighbors_multi(spark, sf):
    ranked = materialize(_ranked(spark, sf), "ranked")
    order = layout.degree_order(ranked, fx.ids(spark, sf), fx.scores(spark, sf), "degree_desc")
    return layout.uniform_groups(layout.group_neighbors_multi(ranked, order, 4, 5))


_FILL = {
    **_WALK, "base": "SELECT * FROM groups",
    "cand": f"SELECT src, rn - 1 AS slot, dst AS node_id FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst = src, dst) AS rn, "
            f"count(*) OVER (PARTITION BY src) AS len FROM ({_LOOPED})) WHERE rn <= 4 AND len >= 4 AND src NOT IN (SELECT node_id FROM base)",
    "fresh": "SELECT src, count(*) AS n FROM (SELECT node_id, min(src) AS src FROM cand WHERE node_id NOT IN (SELECT node_id FROM base) GROUP BY 1) GROUP BY 1",
    "acc": "SELECT c.src, coalesce(sum(4 - coalesce(f.n, 0)) OVER (ORDER BY c.src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
           "FROM (SELECT DISTINCT src FROM cand) c LEFT JOIN fresh f USING (src)",
    "start": "SELECT (SELECT count(*) FROM base) + (SELECT count(*) FROM ids WHERE node_id NOT IN (SELECT node_id FROM base)) AS slots, (SELECT count(*) FROM ids) AS n",
    "kept": "SELECT src, row_number() OVER (ORDER BY src) - 1 + (SELECT count(DISTINCT group_id) FROM base) AS group_id FROM acc, start "
            "WHERE (slots + before) / n::DOUBLE < 1.2::DOUBLE",
}


@query(sql("SELECT group_id, src, slot, node_id FROM base UNION ALL SELECT k.group_id, c.src, c.slot, c.node_id FROM cand c JOIN kept k USING (src)",
           "edges", "ids", "scores", recursive=True, **_FILL))
def fill_groups(spark, sf):
    """The fill step after the real first stage."""
    adj = _self_adj(spark, sf)
    return layout.uniform_groups(layout.fill_groups(adj, _first_groups(spark, sf, adj), fx.ids(spark, sf), 4, 0.2))


_FILL_MULTI = {
    **_WALK_MULTI,
    "active": f"SELECT o.src, o.rn, coalesce(h.n, 0) AS cur FROM ({_order_sql('SELECT src, dst FROM edges', 'DESC')}) o "
              "LEFT JOIN (SELECT src, count(*) AS n FROM groups WHERE slot = 0 GROUP BY src) h USING (src) WHERE coalesce(h.n, 0) < 5",
    "cand": "SELECT a.src, a.rn, r.npos // 4 AS g, r.npos % 4 AS slot, r.dst AS node_id FROM (SELECT *, count(*) OVER (PARTITION BY src) AS len FROM ("
            f"{_RANKED})) r JOIN active a USING (src) WHERE r.npos < 20 AND r.npos // 4 < r.len // 4 AND r.npos // 4 < 5 - a.cur",
    "fresh": "SELECT rn, count(*) AS n FROM (SELECT node_id, min(rn) AS rn FROM cand WHERE node_id NOT IN (SELECT node_id FROM groups) GROUP BY 1) GROUP BY 1",
    "slots": "SELECT rn, count(*) AS n FROM cand GROUP BY rn",
    "acc": "SELECT a.rn, coalesce(sum(coalesce(s.n, 0) - coalesce(f.n, 0)) OVER (ORDER BY a.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
           "FROM active a LEFT JOIN slots s USING (rn) LEFT JOIN fresh f USING (rn)",
    "start": "SELECT (SELECT count(*) FROM groups) + (SELECT count(*) FROM ids WHERE node_id NOT IN (SELECT node_id FROM groups)) AS n, "
             "CAST(floor((SELECT count(*) FROM ids) * 1.4::DOUBLE) AS BIGINT) AS most",
    "served": "SELECT rn FROM acc, start WHERE rn = (SELECT min(rn) FROM active) OR before + n < most",
    "more": "SELECT dense_rank() OVER (ORDER BY rn, g) - 1 + (SELECT count(DISTINCT group_id) FROM groups) AS group_id, src, slot, node_id "
            "FROM cand SEMI JOIN served USING (rn)",
}


@query(sql("SELECT group_id, src, slot, node_id FROM groups UNION ALL SELECT * FROM more", "ids", "edges", "scores", recursive=True, **_FILL_MULTI))
def fill_groups_multi(spark, sf):
    ranked = materialize(_ranked(spark, sf), "ranked")
    order = materialize(layout.degree_order(ranked, fx.ids(spark, sf), fx.scores(spark, sf), "degree_desc"), "order")
    first = layout.group_neighbors_multi(ranked, order, 4, 5)
    return layout.uniform_groups(layout.fill_groups_multi(ranked, first, order, 4, 5, 0.4))


@query(sql("SELECT row_number() OVER (ORDER BY k, group_id, slot, node_id) - 1 AS pos, node_id FROM (SELECT 0 AS k, group_id, slot, node_id FROM cut "
           "UNION ALL SELECT 1, 0, 0, node_id FROM ids WHERE node_id NOT IN (SELECT node_id FROM cut))", "ids", "edges", cut=_CUT))
def node_sequence(spark, sf):
    return layout.node_sequence(_cut_groups(spark, sf), fx.ids(spark, sf))


@query(sql(f"SELECT l.pos, {feat_digest_sql('n.feat')} AS feat_md5 FROM lay l JOIN nodes n USING (node_id)", "scores", "nodes", lay=_LAYOUT))
def reorder_features(spark, sf):
    out = layout.reorder_features(fx.nodes(spark, sf).select("node_id", "feat"), _layout(spark, sf))
    return out.select("pos", feat_digest().alias("feat_md5"))


@query(sql("SELECT row_number() OVER (ORDER BY r NULLS LAST, p NULLS LAST, node_id) - 1 AS pos, node_id FROM (SELECT i.node_id, min(t.batch_id) AS r, "
           "arg_min(t.pos, t.batch_id * 1000000 + t.pos) AS p FROM ids i LEFT JOIN trace t USING (node_id) GROUP BY 1)", "ids", "trace"))
def layout_from_sets(spark, sf):
    """Order of first access over the whole trace, then the nodes never accessed."""
    return layout.layout_from_sets(fx.trace(spark, sf).withColumnRenamed("batch_id", "set_rank"), fx.ids(spark, sf))


_CHAIN = {
    "low": "SELECT node_id, row_number() OVER (ORDER BY degree DESC, node_id) - 1 AS set_id FROM in_deg WHERE degree < 8 ORDER BY degree DESC, node_id LIMIT 100",
    "near": "SELECT set_id, node_id FROM low UNION SELECT l.set_id, e.src FROM edges e JOIN low l ON e.dst = l.node_id UNION "
            "SELECT l.set_id, a.src FROM edges a JOIN edges b ON a.dst = b.src JOIN low l ON b.dst = l.node_id",
    "shared": "SELECT x.set_id AS i, y.set_id AS j, count(b.node_id) AS n FROM low x CROSS JOIN low y LEFT JOIN near a ON a.set_id = x.set_id "
              "LEFT JOIN near b ON b.set_id = y.set_id AND b.node_id = a.node_id GROUP BY ALL",
    "rows_": "SELECT i, list(n ORDER BY j) AS n FROM shared GROUP BY i",
    "chain": "@chain(pos, here, seen) AS (SELECT 0::BIGINT, 0::BIGINT, [0]::BIGINT[] FROM low WHERE set_id = 0 UNION ALL "
             "SELECT pos + 1, list_position(left_, list_max(left_)) - 1, list_append(seen, list_position(left_, list_max(left_)) - 1) FROM ("
             "SELECT c.pos, c.seen, list_transform(r.n, lambda x, j: CASE WHEN list_contains(c.seen, j - 1) THEN -1 ELSE x END) AS left_ "
             "FROM chain c JOIN rows_ r ON r.i = c.here WHERE len(c.seen) < len(r.n)))",
    "first": "SELECT n.node_id, min(struct_pack(a := c.pos, b := CASE WHEN n.node_id = l.node_id THEN -1 ELSE n.node_id END)) AS o "
             "FROM near n JOIN chain c ON c.here = n.set_id JOIN low l USING (set_id) GROUP BY 1",
}


@query(sql("SELECT row_number() OVER (ORDER BY f.o IS NULL, f.o.a, f.o.b, i.node_id) - 1 AS pos, i.node_id FROM ids i LEFT JOIN first f USING (node_id)",
           "ids", "edges", "in_deg", recursive=True, **_CHAIN))
def reorganize_graph(spark, sf):
    return layout.reorganize_graph(fx.edges(spark, sf), fx.ids(spark, sf), 2, below=8, k=100)


_COLOC = ("SELECT node_id, member, row_number() OVER (ORDER BY node_id, slot) - 1 AS pos FROM (SELECT node_id, 0::BIGINT AS slot, node_id AS member FROM ids "
          "UNION ALL SELECT dst, row_number() OVER (PARTITION BY dst ORDER BY src), src FROM edges)")


@query(sql(f"SELECT c.pos, c.node_id, c.member, {feat_digest_sql('n.feat')} AS feat_md5 FROM c JOIN nodes n ON n.node_id = c.member", "ids", "edges", "nodes", c=_COLOC))
def colocate_neighbors(spark, sf):
    out = layout.colocate_neighbors(fx.edges(spark, sf), fx.nodes(spark, sf).select("node_id", "feat"))
    return out.select("pos", "node_id", "member", feat_digest().alias("feat_md5"))


@query(sql("SELECT batch_id, node_id // 4 AS page_id, min(pos) AS first_pos FROM trace GROUP BY 1, 2", "trace"))
def pages_raw(spark, sf):
    return access.pages_raw(fx.trace(spark, sf), 4)


@query(sql("SELECT t.batch_id, l.pos // 4 AS page_id, t.pos AS first_pos FROM trace t JOIN lay l USING (node_id)", "trace", "scores", lay=_LAYOUT))
def pages_reorganized(spark, sf):
    return access.pages_reorganized(fx.trace(spark, sf), _layout(spark, sf), 4)


@query(sql("SELECT t.batch_id, l.pos // 4 AS page_id, min(t.pos) AS first_pos FROM trace t JOIN lay l USING (node_id) GROUP BY 1, 2", "trace", "scores", lay=_LAYOUT))
def pages_reorganized_once(spark, sf):
    return access.pages_reorganized(fx.trace(spark, sf), _layout(spark, sf), 4, dedupe=True)


@query()
def pages_neighbor(spark, sf):
    slots = materialize(layout.colocated_slots(fx.edges(spark, sf), fx.ids(spark, sf)), "slots")
    return access.pages_neighbor(fx.trace(spark, sf), slots, 4)


@query(sql("SELECT 'raw' AS layout, r AS rows_requested, p AS pages_moved, round(p * 16384 / (r * 4096)::DOUBLE, 6) AS amplification FROM (SELECT (SELECT count(*) FROM trace) AS r, "
           "(SELECT count(*) FROM (SELECT DISTINCT batch_id, node_id // 4 FROM trace)) AS p) UNION ALL "
           "SELECT 'by_score', r, p, round(p * 16384 / (r * 4096)::DOUBLE, 6) FROM (SELECT (SELECT count(*) FROM trace) AS r, "
           "(SELECT count(*) FROM (SELECT DISTINCT t.batch_id, l.pos // 4 FROM trace t JOIN lay l USING (node_id))) AS p)", "trace", "scores", lay=_LAYOUT))
def layout_report(spark, sf):
    trace = fx.trace(spark, sf)
    pages = {"raw": access.pages_raw(trace, 4), "by_score": access.pages_reorganized(trace, _layout(spark, sf), 4, dedupe=True)}
    out = access.layout_report(trace, pages, 4096, 16384)
    return out.select("layout", "rows_requested", "pages_moved", F.round("amplification", 6).alias("amplification"))


_COLD = f"SELECT src, dst FROM ({_LOOPED}) WHERE dst NOT IN (SELECT node_id FROM hot)"
_PREPARED = {
    "hot": "SELECT node_id FROM scores ORDER BY score DESC, node_id LIMIT (SELECT CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) FROM scores)",
    "cold": _COLD,
    **_walk_ctes("SELECT src, list(dst ORDER BY dst = src, dst) AS nb FROM cold GROUP BY src", _order_sql("SELECT src, dst FROM cold", "ASC"), 4, 1, True),
    **{n: t.replace(f"({_LOOPED})", "cold") for n, t in _FILL.items() if n not in _WALK},
    "whole": "SELECT group_id, src, slot, node_id FROM base UNION ALL SELECT k.group_id, c.src, c.slot, c.node_id FROM cand c JOIN kept k USING (src)",
    "seq": "SELECT row_number() OVER (ORDER BY k, group_id, slot, node_id) - 1 AS pos, node_id FROM (SELECT 0 AS k, group_id, slot, node_id FROM whole "
           "UNION ALL SELECT 1, 0, 0, node_id FROM ids WHERE node_id NOT IN (SELECT node_id FROM whole))",
}


@query(sql("SELECT 'groups' AS part, group_id AS pos, slot, node_id FROM whole UNION ALL SELECT 'sequence', pos, 0::BIGINT, node_id FROM seq",
           "ids", "edges", "scores", recursive=True, **_PREPARED))
def prepare_layout(spark, sf):
    """The offline job end to end: its groups and its node sequence."""
    e = fx.edges(spark, sf)
    hot = ordering.top_nodes(fx.scores(spark, sf), share=0.1).select("node_id")
    out = layout.prepare_layout(e, fx.ids(spark, sf), fx.nodes(spark, sf).select("node_id", "feat"), fx.scores(spark, sf), hot)
    groups = out["groups"].select(F.lit("groups").alias("part"), F.col("group_id").cast("bigint").alias("pos"), F.col("slot").cast("bigint").alias("slot"), "node_id")
    places = out["sequence"].select(F.lit("sequence").alias("part"), "pos", F.lit(0).cast("bigint").alias("slot"), "node_id")
    return groups.unionByName(places)


# Streams ------------------------------------------------------------------------

_ITEMS = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType())])
_EVENTS = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType())])


def _item_stream(spark, sf):
    items = feeds.file_stream(spark, sf, _ITEMS, "lineitem.parquet")
    return items.select(F.floor(F.col("l_orderkey") / F.lit(PER_BATCH)).cast("bigint").alias("batch_id"), F.col("l_partkey").alias("node_id"))


@query(sql(f"SELECT t.batch_id, t.node_id, {feat_digest_sql('n.feat')} AS feat_md5 FROM trace t JOIN nodes n USING (node_id)", "trace", "nodes"))
def stream_gather(spark, sf):
    tasks = spark.sparkContext.defaultParallelism
    out = feeds.stream_gather(_item_stream(spark, sf), fx.nodes(spark, sf).select("node_id", "feat"), tasks)
    return feeds.run_to_table(out.select("batch_id", "node_id", feat_digest().alias("feat_md5")), "append", "gathered")


@query(sql(f"SELECT t.batch_id, t.node_id, CASE WHEN t.node_id IN (SELECT node_id FROM (SELECT node_id FROM scores ORDER BY score DESC, node_id LIMIT "
           "(SELECT CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) FROM scores))) THEN 'pinned' ELSE 'storage' END AS tier FROM trace t", "trace", "scores"))
def stream_tiers(spark, sf):
    """Which tier serves each arriving access."""
    hot = ordering.top_nodes(fx.scores(spark, sf), share=0.2).select("node_id")
    out = gather.tag_tier(_item_stream(spark, sf), hot).select("batch_id", "node_id", "tier")
    return feeds.run_to_table(out, "append", "tiers")


@query(sql("SELECT node_id, count(*) AS n_batches FROM visits GROUP BY node_id", "visits"))
def stream_frequency(spark, sf):
    return feeds.run_batch_frequency(_item_stream(spark, sf))


@query(sql("SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day, user_id AS node_id, count(*) AS n FROM events GROUP BY 1, 2"))
def stream_windowed_frequency(spark, sf):
    """Counts per day from files in no time order: rows that come late are counted all the same."""
    folder = fresh_path(spark, "events")
    fx.table(spark, sf, "events").repartition(4, "event_id").write.parquet(folder)
    events = feeds.file_stream(spark, folder, _EVENTS).withColumnRenamed("user_id", "node_id")
    last = feeds.run_windowed_frequency(events, "1 day", "1 hour")
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "node_id", "n")


