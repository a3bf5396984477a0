"""URL filters by a sort-merge range join.

A host's labels in reverse order, each with a dot after it, are its key: the key of a host begins with
the key of every domain above it. A rule's domain is thus an interval of keys, and intervals are nested
or apart. Urls and interval starts are sorted together and swept: the last start at or before a url
names the innermost rule that may be open there, and that rule carries the stack of the rules around
it. Those whose interval has ended are popped, those whose path does not fit are passed over, and the
longest left decides.

The sweep runs in many sections at once: one for each two-label domain, or several, each with part of
the urls, for a domain that holds many. A rule starts in the sections of its own domain or, if it has a
single label, in all those under it. A domain has so few sections that its rules, repeated in each,
stay well below its urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, read_table

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_host(url: Column) -> Column:
    """From after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host, to `?`, `#` or the end."""
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    """www.example.com gives com.example.www. (with the last dot)."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def section(key: Column) -> Column:
    """The first two labels of a key."""
    return F.substring_index(key, ".", 2)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(key, end, labels, stack): one row for each ruled domain. stack has the rules of the domain and of
    all above it, as (weight, name, path, end, verdict). A key's labels give the domains above by
    equality, so no rules are compared in pairs."""
    host = F.translate(F.trim(F.coalesce("host", F.lit(""))), UPPER, LOWER)
    one = rules.where("host is not null and host <> '' and verdict in ('allow', 'block')").select(host_key(host).alias("key"), host.alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "verdict")
    one = one.select(
        "key",
        F.struct(
            F.struct(F.length("host"), F.length("path"), (F.col("verdict") == "block").cast("int").alias("block")).alias("weight"),
            F.concat("host", "path").alias("name"),
            "path",
            F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("end"),  # the least string after all that begin with the key
            "verdict",
        ).alias("rule"),
    )
    own = one.groupBy("key").agg(F.collect_set("rule").alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    above = own.select(F.col("key").alias("inner"), F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("key"))
    stacks = above.join(own, "key").groupBy("inner").agg(F.flatten(F.collect_list("own")).alias("stack"))
    return stacks.select(F.col("inner").alias("key"), F.size(F.split("inner", r"\.", -1)).alias("labels"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    rules has verdict (allow or block), host and path. A rule fits its host and all subdomains, if the
    path starts with the rule's; the longest host and then path wins, and block wins over allow for the
    same host and path. `rule` is the winner's host and path, else null, and the verdict then `default`.
    Rules without host or verdict are passed over.

    A null url, or one without `://`, has empty host and path, which no rule fits. Null and repeated
    page_ids keep their rows. Empty rules leave all to the default. Other columns are not looked at.

    A section with more than its share of the urls, one of `parts` (by default as many as the shuffle has
    partitions), is swept in several parts. Urls alike part too, as their places in the table deal them.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) if parts is None else parts
    share = max(1, -(-pages.count() // parts))
    ready = prepare_rules(rules)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
    urls = urls.select("page_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"), F.monotonically_increasing_id().alias("at"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("section", section(F.col("key")))
    ready = ready.withColumn("section", section(F.col("key")))
    # sections above their share, with the number of parts; rules repeated in the parts are at most a tenth of the urls
    crowded = urls.groupBy("section").count().where(F.col("count") > share)
    ruled = ready.groupBy("section").agg(F.count("*").alias("rules"))
    part = F.greatest(F.lit(share), 10 * F.coalesce("rules", F.lit(0)))
    crowded = crowded.join(ruled, "section", "left").select("section", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    dealt = F.coalesce("parts", F.lit(1))
    urls = urls.join(crowded, "section", "left").withColumn("salt", F.pmod(F.xxhash64("at"), dealt).cast("int"))
    none = F.lit(None)
    starts = ready.join(crowded, "section", "left").select("section", "key", "stack", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("salt"))
    # one label: the rule opens every section under it
    wide = ready.where("labels = 2").select(F.col("key").alias("wide"), "stack")
    under = urls.groupBy("section", "salt").count().select("section", "salt", F.concat(F.substring_index("section", ".", 1), F.lit(".")).alias("wide"))
    starts = starts.unionByName(under.join(wide, "wide").select("section", F.col("wide").alias("key"), "stack", "salt"))
    starts = starts.select("section", "salt", "key", F.lit(0).alias("kind"), none.cast("long").alias("page_id"), none.cast("string").alias("host"), none.cast("string").alias("path"), "stack")
    kind = starts.schema["stack"].dataType
    events = urls.select("section", "salt", "key", F.lit(1).alias("kind"), "page_id", "host", "path", none.cast(kind).alias("stack")).unionByName(starts)
    # without this, the window would take over the partitions of the join above, a section in each
    events = events.repartition("section", "salt")
    order = Window.partitionBy("section", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    fits = F.filter("open", lambda r: (F.col("key") < r["end"]) & F.startswith(F.col("path"), r["path"]) & (F.col("host") != ""))
    winner = F.array_max(fits)
    return swept.withColumn("w", winner).select("page_id", "host", "path", F.col("w.name").alias("rule"), F.coalesce("w.verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(read_table(spark, sf_dir, "pages"), rules)


OP7_SQL = """
with p as (select page_id, coalesce(url, '') as url from pages),
r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else null end as rest from p),
u as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from r),
rules(verdict, host, path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
j as (select u.page_id, u.host, u.path, k.host || k.path as rule, k.verdict,
  row_number() over (partition by u.page_id order by length(k.host) desc nulls last, length(k.path) desc) as n
  from u left join rules k on (u.host = k.host or u.host like '%.' || k.host) and starts_with(u.path, k.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from j where n = 1
"""
