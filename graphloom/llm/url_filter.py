"""URL allow and block rules by a sorted sweep over intervals of canonical keys; DataFrame functions only.

A rule's key is its host with the labels reversed, a separator and its path; all keys that begin with
it are one interval.  The intervals of a host are nested or apart.  A sweep over the rules' starts and ends in
order keeps the stack of active rules: a start at depth d is on top until the depth falls below d, so
the top after any event is the last start at the depth that the event leaves.  This cuts the key space
into segments with one innermost rule each.  Segments and the urls' keys are dealt out together by
ranges of the key, and the segment that is open at the start of a range is carried there from the ranges before; in
a range's order every key takes the last segment before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATOR = "\x01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased.  Path: then up to ?, # or the end."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), ASCII, ASCII.lower())
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _key(reversed_host: Column, path: Column) -> Column:
    return F.encode(F.concat(reversed_host, F.lit(SEPARATOR), path), "UTF-8")


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def segments(rules: DataFrame) -> DataFrame:
    """(key, top): from key on, up to the next row's key, top is the innermost rule (rhost, host, path, verdict) or has nulls."""
    host = F.translate("host", ASCII, ASCII.lower())
    rule = F.struct("rhost", "host", "path", "verdict")
    keyed = rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL").select(host.alias("host"), "path", "verdict").withColumn("rhost", _reversed(F.col("host")))
    keyed = keyed.groupBy("rhost", "host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", _key(F.col("rhost"), F.col("path")))  # of repeated rules, allow
    event = F.explode(F.array(F.struct("key", F.lit(1).alias("step")), F.struct(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(-1).alias("step"))))
    events = keyed.select("rhost", rule.alias("rule"), event.alias("e")).select("rhost", "e.*", F.when(F.col("e.step") == 1, F.col("rule")).alias("rule"))
    # Rules of different hosts are never nested, so the stack needs one order within each.
    depth = events.withColumn("depth", F.sum("step").over(Window.partitionBy("rhost").orderBy("key")))
    last = F.last("rule", ignorenulls=True).over(Window.partitionBy("rhost", "depth").orderBy("key"))
    top = F.when(F.col("depth") > 0, last)
    return depth.select("key", F.struct(*[top[c].alias(c) for c in ("rhost", "host", "path", "verdict")]).alias("top"))


def judge(df: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """One row per row of df: (page_id, host, path, rule, verdict).

    rules: (host, path, verdict).  A rule fits its host and all subdomains if the path starts with its
    path; of several, the longest host and path together win, then the longest host.  Without one, rule
    is null and the verdict is ``default``.  A null url or one without :// has an empty host and path.
    Repeated rows are judged once and each gets its row; other columns are ignored.  A url is looked up under as many labels of its host as some rule has,
    so that long hosts cost no more than others.  ranges: of the key; the session's shuffle partitions, if None.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_col))
    url = ["page_id", "host", "path"]
    urls = df.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).groupBy(*url).agg(F.count(F.lit(1)).alias("n"))
    stack = segments(rules)
    depths = [r["d"] for r in stack.where("top.rhost IS NOT NULL").select(F.size(F.split("top.rhost", r"\.")).alias("d")).distinct().collect()]  # as many as hosts have labels
    labels = F.reverse(F.split("host", r"\."))
    known = F.filter(F.array(*map(F.lit, sorted(depths))).cast("array<int>"), lambda d: (d <= F.size(labels)) & (F.col("host") != ""))
    probes = urls.select(*url, F.explode(F.transform(known, lambda d: F.array_join(F.slice(labels, F.lit(1), d), "."))).alias("of")).withColumn("key", _key(F.col("of"), F.col("path")))
    events = stack.select("key", "top", F.lit(0).alias("kind")).unionByName(probes.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # Equal keys are dealt over ranges as well, by the last column.
    dealt = cut(events.repartitionByRange(ranges, "key", "kind", F.xxhash64("page_id", "path")).withColumn("range", F.spark_partition_id()))
    ends = dealt.where("kind = 0").groupBy("range").agg(F.max_by("top", "key").alias("end"))
    each = df.sparkSession.range(ranges).select(F.col("id").cast("int").alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    opened = each.join(ends, "range", "left").select("range", F.last("end", ignorenulls=True).over(before).alias("open"))  # one row a range
    swept = dealt.join(F.broadcast(opened), "range").withColumn("found", F.coalesce(F.last("top", ignorenulls=True).over(Window.partitionBy("range").orderBy("key", "kind")), F.col("open")))
    rule = F.when(F.col("found.rhost") == F.col("of"), F.struct(F.length(F.concat("found.host", "found.path")).alias("n"), F.length("found.host").alias("h"), F.col("found")))
    judged = swept.where("kind = 1").select(*url, rule.alias("best")).where("best IS NOT NULL")
    best = urls.unionByName(judged, allowMissingColumns=True).groupBy(*url).agg(F.max("n").alias("n"), F.max("best").alias("best"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(
        *url, F.concat("best.found.host", "best.found.path").alias("rule"), F.coalesce("best.found.verdict", F.lit(default)).alias("verdict")
    )
