"""Reports: site statistics, feedback, metrics, guard tallies, regressions, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def site_stats(chunks: DataFrame, site: Column, page: str = "source_url", updated: str = "last_updated") -> DataFrame:
    return chunks.groupBy(site.alias("site_id")).agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct(page).alias("page_count"), F.max(updated).alias("last_updated"))


def feedback_summary(votes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, up, down, up_rate of (vote); votes of another kind count in the total only."""
    up, down = F.count_if(F.col("vote") == "up"), F.count_if(F.col("vote") == "down")
    grouped = votes.groupBy(*by) if by else votes.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("total"), up.alias("up"), down.alias("down"), F.when(F.count(F.lit(1)) > 0, F.round(up / F.count(F.lit(1)), 4)).alias("up_rate"))


def first_low_rated(votes: DataFrame, order: str, n: int = 10, latest: bool = False) -> DataFrame:
    low = votes.where(F.col("vote") == "down")
    return low.orderBy(F.col(order).desc() if latest else F.col(order)).limit(n)


def metric_summary(scores: DataFrame, by: list[str], value: str, threshold: float, digits: int = 4) -> DataFrame:
    """mean, n, pass_rate; null scores are errors and are left out."""
    v = F.col(value)
    return scores.where(v.isNotNull()).groupBy(*by).agg(F.round(F.avg(v), digits).alias("mean"), F.count(F.lit(1)).alias("n"), F.round(F.avg((v >= threshold).cast("double")), 4).alias("pass_rate"))


def verdict_tally(verdicts: DataFrame, guard: str = "guard", level: str = "level") -> DataFrame:
    """Safe, unsafe and uncertain verdicts of each guard and its pass rate (4 digits)."""
    counts = [F.count_if(F.col(level) == x).alias(x) for x in ("safe", "unsafe", "uncertain")]
    return verdicts.groupBy(guard).agg(*counts, F.round(F.count_if(F.col(level) == "safe") / F.count(F.lit(1)), 4).alias("pass_rate"))


def severity_histogram(verdicts: DataFrame, severity: str = "severity", passed: str = "passed") -> DataFrame:
    return verdicts.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(passed)).alias("blocked"), *[F.count_if(F.col(severity) == s).alias(s) for s in ("low", "med", "high")])


def regressions(reports: DataFrame, by: list[str], ts: str = "ts", value: str = "value", limit: float = 0.05) -> DataFrame:
    """Each report with the one before, the change, and whether it fell by more than the limit."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(ts))
    return reports.withColumn("prior", before).withColumn("delta", F.round(F.col(value) - F.col("prior"), 6)).withColumn("regressed", F.coalesce(F.col("delta") < -limit, F.lit(False)))


def prior_report(reports: DataFrame, at: Column, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """The last report before a time."""
    return reports.where(F.col(ts) < at).groupBy(*by).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def sync_totals(delta: DataFrame, by: str = "label") -> DataFrame:
    """Counts by change and the status: OK, PARTIAL with some failures, FAILED with nothing but failures."""
    failed = F.count_if(~F.col("applied"))
    counts = [F.count_if((F.col("change") == c) & F.col("applied")).alias(c.lower()) for c in ("NEW", "MODIFIED", "DELETED", "UNCHANGED")]
    status = F.when(failed == 0, "OK").when(failed < F.count(F.lit(1)), "PARTIAL").otherwise("FAILED")
    return delta.groupBy(by).agg(*counts, failed.alias("embed_failed"), status.alias("status"))


def directory_sizes(files: DataFrame, depth: int, path: str = "path", size: str = "size_bytes", at_least: int = 0, top: int = 20) -> DataFrame:
    """(directory, bytes) by the first `depth` parts of the path, largest first."""
    return files.groupBy(F.substring_index(path, "/", depth).alias("directory")).agg(F.sum(size).alias("bytes")).where(F.col("bytes") > at_least).orderBy(F.desc("bytes"), "directory").limit(top)


def sizes_per_root(files: DataFrame, roots: list[str], levels: int | None = 1, at_least: int = 0, top: int = 20, path: str = "path", size: str = "size_bytes") -> DataFrame:
    """(root, entry, bytes, rank): for each root its largest directories and files, of at most `levels` levels below it
    (None: of any), with all that is under them; those over at_least bytes, the first `top` of each root.

    One shuffle adds the sizes of all levels. An entry under one that is listed before it, of the same root, is left
    out. Roots may lie in each other; a path that is under several counts for each.
    """
    under = F.filter(F.array(*[F.lit(r.rstrip("/")) for r in roots]), lambda r: F.startswith(F.col(path), F.concat(r, F.lit("/"))))
    rows = files.select(path, size, F.explode(under).alias("root"))
    rest = rows.select("root", size, F.split(F.substring(F.col(path), F.length("root") + 2, F.length(path)), "/").alias("parts"))
    depth = F.size("parts") if levels is None else F.least(F.size("parts"), F.lit(levels))
    entries = rest.select("root", size, F.explode(F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("entry"))
    sums = entries.groupBy("root", "entry").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > at_least)
    order = Window.partitionBy("root").orderBy(F.desc("bytes"), "entry")
    first = sums.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top)
    listed = F.collect_list("entry").over(Window.partitionBy("root"))  # of `top` rows at most
    apart = first.withColumn("listed", listed).where(~F.exists("listed", lambda e: F.startswith(F.col("entry"), F.concat(e, F.lit("/")))))
    return apart.select("root", F.concat("root", F.lit("/"), "entry").alias("entry"), "bytes", F.row_number().over(order).alias("rank"))


def reclaimable(sizes: DataFrame, kind: Column, size: str = "bytes") -> DataFrame:
    return sizes.agg(F.coalesce(F.sum(F.when(kind.isin("safe-cache", "project-rebuild", "system-app"), F.col(size))), F.lit(0)).alias("reclaimable"))


def probe_summary(answers: DataFrame) -> DataFrame:
    """Rows (answered, language_ok, source_ok): n and the share that passed all."""
    all_ok = F.col("answered") & F.col("language_ok") & F.col("source_ok")
    return answers.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(all_ok.cast("double")), 4).alias("pass_rate"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    one = None
    for name, t in tables.items():
        part = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n")
        one = part if one is None else one.unionByName(part)
    return one
