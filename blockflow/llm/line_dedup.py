"""Line dedup by site-relative frequency, in DataFrame functions only.

A line (text between U+000A, outer U+0020 ignored) is boilerplate of its
host when the pages of that host containing it are more than ``ratio`` of the
host's pages, at least ``least_pages`` in number.  Boilerplate lines are
dropped from every page of the host; all other lines, blank ones too, stay
in place.

Plan.  One pass sends each page's distinct line hashes (8 bytes, not the
lines) as (host, hash), combined before the shuffle, so a common line of a
hot host is one row per task.  The boilerplate set per host is bounded by the
lines of a mean page over ``ratio``.  Its size is looked at: within
``broadcast_rows`` it is broadcast and the pages never move; beyond, pages
meet their host's set in a shuffle join, where hosts with over 1/200 of all
pages are spread over ``salts`` copies of their set.

A line is compared by its 64-bit hash within its host; a line would be
dropped wrongly only if its hash equalled that of a boilerplate line of the
same host (chance about 1e-19 per pair).

Defined cases: a null host is a host of its own; a null text has no lines,
counts as a page and stays null; an empty text is one blank line; blank lines
are never dropped; a line repeated inside a page counts once there and each
of its places is dropped; repeated rows are pages of their own unless
``copies_once`` is set (as in the pipeline, where near-dedup follows); a page
whose lines all go keeps an empty text.  Other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, hot_keys, table, written

RATIO, LEAST_PAGES = 0.01, 5


def _hash(line):
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO,
                least_pages: int = LEAST_PAGES, copies_once: bool = False) -> tuple[DataFrame, DataFrame]:
    """((host, hash) of boilerplate lines, (host, pages) of all hosts)."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    hashes = F.array_distinct(F.transform(lines, _hash))
    hosts = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    if copies_once:
        one = pages.groupBy(F.col(host).alias("host"), F.xxhash64(text).alias("page")).agg(F.first(hashes).alias("hashes"))
        one = written(one, "pages")
        seen = one.select("host", F.explode("hashes").alias("hash"))
        per = one.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("pages"))
    else:
        seen = pages.select(F.col(host).alias("host"), F.explode(hashes).alias("hash"))
        per = hosts.select(F.col("host").alias("h"), "pages")
    seen = seen.groupBy("host", "hash").agg(F.count("*").alias("found")).where(F.col("found") >= least_pages)
    found = seen.join(per, F.col("host").eqNullSafe(F.col("h"))).where(F.col("found") > ratio * F.col("pages"))
    return found.select("host", "hash"), hosts


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                     least_pages: int = LEAST_PAGES, broadcast_rows: int = 200_000, salts: int = 64,
                     counted: bool = False, copies_once: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text``; with ``counted``
    two more columns, ``n_lines`` and ``n_dropped``.  With ``copies_once``
    equal texts of a host are one page in all counts."""
    found, hosts = boilerplate(pages, host, text, ratio, least_pages, copies_once)
    found = written(found, "boilerplate")
    sets = found.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
    key, drop, salt = free_name(pages, "host"), free_name(pages, "drop"), free_name(pages, "salt")
    sets = sets.select(F.col("host").alias(key), F.col("hashes").alias(drop))
    if found.count() <= broadcast_rows:
        marked = pages.join(F.broadcast(sets), F.col(host).eqNullSafe(F.col(key)), "left")
    else:
        hosts = written(hosts, "hosts")
        total = hosts.agg(F.sum("pages")).first()[0]
        hot = [r["host"] for r in hot_keys(hosts, "pages", total).collect()]         # fewer than 200
        names = [h for h in hot if h is not None]
        spread = F.coalesce(F.col(host).isin(names), F.lit(None in hot)) if names else F.lit(None in hot) & F.col(host).isNull()
        set_spread = F.coalesce(F.col(key).isin(names), F.lit(None in hot)) if names else F.lit(None in hot) & F.col(key).isNull()
        pages = pages.withColumn(salt, F.when(spread, F.pmod(F.xxhash64(*pages.columns), F.lit(salts))).otherwise(F.lit(0).cast("long")))
        side = free_name(pages, "set_salt")
        sets = sets.withColumn(side, F.explode(F.when(set_spread, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
                                               .otherwise(F.array(F.lit(0).cast("long")))))
        marked = pages.join(sets.hint("shuffle_hash"), F.col(host).eqNullSafe(F.col(key)) & (F.col(salt) == F.col(side)), "left").drop(salt, side)
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop), _hash(x)))
    hit = F.col(drop).isNotNull() & F.col(text).isNotNull()
    if counted:
        n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines))
        marked = marked.withColumn("n_lines", n).withColumn(
            "n_dropped", F.when(hit, F.size(lines) - F.size(kept)).otherwise(F.lit(0)))
    marked = marked.withColumn(text, F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text)))
    return marked.drop(key, drop)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site boilerplate lines dropped from every document, the source as the site."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, counted=True).select("doc_id", "text", "n_lines", "n_dropped")


OP3_SQL = f"""
with d as (select doc_id, source, string_split(text, chr(10)) as ls from documents),
     seen as (select source, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: x <> ''))) as line from d),
     cnt as (select source, line, count(*) as c from seen group by all),
     tot as (select source, count(*) as n from d group by all),
     bp as (select cnt.source, list(line) as b from cnt join tot on cnt.source is not distinct from tot.source
            where c >= {LEAST_PAGES} and c > {RATIO} * n group by all),
     m as (select doc_id, ls, list_filter(ls, lambda x: trim(x) = '' or b is null or not list_contains(b, trim(x))) as kept
           from d left join bp on d.source is not distinct from bp.source)
select doc_id, case when ls is null then null else array_to_string(kept, chr(10)) end as text,
       cast(coalesce(len(ls), 0) as integer) as n_lines, cast(coalesce(len(ls) - len(kept), 0) as integer) as n_dropped
from m
"""
