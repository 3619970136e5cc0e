"""Adapter views that give the driver's tables the shapes of tag counts, positions, intervals and matrices.

The texts are SQL that Spark and DuckDB both read; oracles put them in a leading WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAP16 = "'0123456789abcdef','ACGTACGTACGTACGT'"

VIEWS = {
    "tag_position": f"SELECT substr(translate(md5(CAST(l_partkey AS STRING)),{MAP16}),1,17+l_linenumber) AS tag, 17+l_linenumber AS len, l_partkey % 5 + 1 AS chr, CASE WHEN l_returnflag='R' THEN 'c' ELSE 'w' END AS strand, l_orderkey*40 + CAST(floor(l_orderkey/50) AS BIGINT)*1000 + l_linenumber*21 + 1 AS pos, 'L' || CAST(l_suppkey % 4 AS STRING) AS lib, CAST(l_quantity AS BIGINT) AS abun FROM lineitem",
    "tag_count": "SELECT lib, tag, CAST(sum(abun) AS BIGINT) AS abun FROM tag_position GROUP BY lib, tag",
    "transcript": "SELECT 'G' || CAST(o_custkey AS STRING) AS gene, 'T' || CAST(o_orderkey AS STRING) AS trans, o_custkey % 5 + 1 AS chr, CASE WHEN o_orderstatus='O' THEN 'c' ELSE 'w' END AS strand, o_orderkey*40 + CAST(floor(o_orderkey/50) AS BIGINT)*1000 + 1 AS tstart, o_orderkey*40 + CAST(floor(o_orderkey/50) AS BIGINT)*1000 + 201 + o_orderkey % 800 AS tend FROM orders",
    "exon": "SELECT t.trans, t.chr, t.strand, t.tstart + (l.l_linenumber-1)*60 AS xstart, t.tstart + (l.l_linenumber-1)*60 + 39 AS xend, l.l_linenumber AS exon_no FROM lineitem l JOIN transcript t ON t.trans = 'T' || CAST(l.l_orderkey AS STRING)",
    "locus": "SELECT 'PH' || CAST(event_id AS STRING) AS name, event_id % 7 + 1 AS neglog_p, user_id % 5 + 1 AS chr, event_id*90 + 1 AS lstart, event_id*90 + 151 + event_id % 250 AS lend, event_type AS lib FROM events",
    "seqs": f"SELECT 'S' || CAST(doc_id AS STRING) AS name, translate(md5(text) || md5(lang || text) || md5(source || text),{MAP16}) AS seq FROM documents",
    "expr": "SELECT 'G' || CAST(l_partkey AS STRING) AS gene, 'S' || CAST(l_suppkey % 6 AS STRING) AS sample, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt FROM lineitem GROUP BY 1, 2",
    "probe": "SELECT 'P' || CAST(p_partkey AS STRING) AS probe, p_brand AS track, p_size % 5 + 1 AS chr, p_partkey*700 AS pstart, p_partkey*700 + 500 AS pend, p_retailprice AS fc FROM part",
    "meth": "SELECT l_suppkey % 3 AS lib_id, l_partkey % 5 + 1 AS chr_id, l_orderkey*5 + l_linenumber AS position, CAST(l_quantity AS BIGINT) AS cmethylated, CAST(l_quantity AS BIGINT) + l_linenumber * 5 AS totalc, CASE l_returnflag WHEN 'A' THEN 'CG' WHEN 'N' THEN 'CHG' ELSE 'CHH' END AS type FROM lineitem",
    "signal": "SELECT 'U' || CAST(user_id AS STRING) AS name, event_id AS idx, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS val FROM events",
    "cell": "SELECT o.o_custkey AS cell, 'g' || CAST(l.l_partkey % 60 AS STRING) AS gene, CAST(sum(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS cnt FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2",
}
NEEDS = {"tag_count": ("tag_position",), "exon": ("transcript",)}
BASE = {"tag_position": ("lineitem",), "tag_count": ("lineitem",), "transcript": ("orders",), "exon": ("lineitem", "orders"), "locus": ("events",), "seqs": ("documents",), "expr": ("lineitem",), "probe": ("part",), "meth": ("lineitem",), "signal": ("events",), "cell": ("lineitem", "orders")}
LIBS = ("L0", "L1", "L2", "L3")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter view over the tables in sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE[name]}
    with_ = "".join(f"{n} AS ({VIEWS[n]}), " for n in NEEDS.get(name, ()))
    text = f"WITH {with_}{name} AS ({VIEWS[name]}) SELECT * FROM {name}"
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **tables) if "JOIN orders" not in text else spark.sql(text.replace("JOIN orders", "JOIN {orders}"), **tables)


def with_views(sql: str, *names: str) -> str:
    """sql after a WITH clause of the named views and those that they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {sql[15:]}"
    return f"WITH {parts}, {sql.lstrip()[5:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {parts} {sql}"
