"""URL rules as a sort-merge range join.

A rule (host, path) fits its host and all subdomains when the path of the url starts with the rule's path.
Hosts are written with their labels reversed, so that each parent domain of a url is a prefix of its key; a
url looks at the parent domains that have rules. Within a parent domain the rules are nested intervals
[path, path + 0xFF] of byte strings. Interval ends and urls are sorted together and swept; the number of open
intervals is the height of the stack of active rules, and the rule on top of it at height h is the last one
opened at height h. Busy domains are dealt to many sweeps, each with its own copy of the domain's rules; a
sweep gets at least as many urls as rules, so the copies never outweigh the urls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimspark.llm.common import lower_ascii, partitions


def url_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``; both empty where the url is NULL or has no ``://``."""
    start = F.instr(F.col(url_col), "://")
    rest = F.when(start > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns({
        "host": lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def _reversed_labels(host):
    return F.reverse(F.split(host, r"\."))


def _label_count(host: str):
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def url_filter(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``. The longest fitting rule (host and path together, then host) wins;
    ``rule`` is host followed by path. Without one ``rule`` is NULL and the verdict is ``default``. If a rule
    is given twice with different verdicts, ``block`` wins; rules with a NULL host or path are ignored. NULL
    or malformed urls have empty host and path and fit no rule with a host; NULL ids and repeated rows are
    judged like others. Other columns are ignored. Empty tables give an empty result or no rules. The work for a
    url grows with its length and with the numbers of labels that rules have, which are brought to the driver.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = url_parts(urls).groupBy("page_id", "host", "path").agg(F.count("*").alias("rows"))
    rules = rules.dropna(subset=["host", "path"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumns({"domain": F.array_join(_reversed_labels(F.col("host")), "."), "rule": F.concat("host", "path")})
    # One row per url and parent domain with as many labels as some rule has: com, com.example. A long host adds no rows.
    depths = sorted(r["depth"] for r in rules.select(_label_count("host").alias("depth")).distinct().collect())
    depth = F.explode(F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda n: n <= _label_count("host")))
    levels = urls.select("page_id", "host", "path", depth.alias("depth"))
    levels = levels.withColumn("domain", F.array_join(_reversed_labels(F.expr("substring_index(host, '.', -depth)")), ".")).drop("depth")
    ruled = rules.groupBy("domain").agg(F.count("*").alias("n_rules"))
    wanted = levels.join(ruled.select("domain"), "domain", "left_semi")
    busy = wanted.groupBy("domain").agg(F.count("*").alias("n_urls")).join(ruled, "domain")
    busy = busy.withColumn("share", F.col("n_urls") / max(1, pages.count()))
    sweeps = F.greatest(F.lit(1), F.least(F.ceil(F.col("share") * 2 * partitions(spark)), F.floor(F.col("n_urls") / F.col("n_rules"))))
    domains = busy.select("domain", sweeps.cast("int").alias("sweeps"))
    nothing = F.lit(None)
    url_rows = wanted.join(domains, "domain").select(
        "domain", F.pmod(F.xxhash64("page_id", "host", "path"), F.col("sweeps")).cast("int").alias("sweep"),
        F.encode("path", "utf-8").alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"),
        "page_id", "host", "path", nothing.cast("string").alias("rule"), nothing.cast("string").alias("verdict"),
    )
    ends = rules.join(domains, "domain").withColumn("sweep", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)))
    start = F.encode("path", "utf-8")
    ends = ends.withColumn("end", F.explode(F.array(
        F.struct(start.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
        F.struct(F.concat(start, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step")),
    ))).select(
        "domain", "sweep", "end.key", "end.kind", "end.step",
        nothing.cast(pages.schema[id_col].dataType).alias("page_id"), nothing.cast("string").alias("host"),
        nothing.cast("string").alias("path"), "rule", "verdict",
    )
    sweep = Window.partitionBy("domain", "sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_height = Window.partitionBy("domain", "sweep", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("kind") == 0, F.struct(
        (F.length("rule")).alias("length"), F.length(F.regexp_extract("rule", "^[^/]*", 0)).alias("host_length"), "rule", "verdict",
    ))
    found = (
        url_rows.unionByName(ends)
        .withColumn("height", F.sum("step").over(sweep))
        .withColumn("top", F.last(opened, ignorenulls=True).over(at_height))
        .filter("kind = 1 and height > 0")
        .select("page_id", "host", "path", "top", F.lit(0).cast("long").alias("rows"))
    )
    top_type = found.schema["top"].dataType
    judged = (
        urls.select("page_id", "host", "path", F.lit(None).cast(top_type).alias("top"), "rows")
        .unionByName(found)
        .groupBy("page_id", "host", "path")
        .agg(F.max("top").alias("top"), F.sum("rows").alias("rows"))
    )
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )
