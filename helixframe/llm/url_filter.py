"""URL filter: explicit rules first, then a path-template tree, in DataFrame functions only.

A page's URL gives a host and a path.  The longest fitting rule decides; the
pages that rules decide are also the labelled examples from which the method
learns (other labels can be given).  For each host the paths form a tree over
all their segments:

* segments that vary by kind (numbers, hexadecimal identifiers, UUIDs) become
  typed wildcards;
* sibling branches are on the bad side when most of their labelled pages are
  bad, and on the other side otherwise, also when they have none; branches of
  one side whose children are distributed alike, by a chi-squared test of each
  against all of that side, and whose shares of bad labelled pages agree with
  it, merge into ``*`` (``*bad`` on the bad side), so a branch without labels
  never inherits what its labelled siblings are rejected for;
* what results is the template.  A template is rejected when its share of bad
  labelled pages, smoothed towards ``prior``, reaches ``reject_at``.

All statistics are sums by key over distinct typed paths, partially aggregated
before each shuffle, and their results are looked up without gathering a
frequent key: a host may own a third of the pages, a node any number of
branches, and a typed path any number of pages.

Edge cases: a URL that is null or has no ``://`` has an empty host and path.
Without any labelled page nothing is rejected.  Repeated rows repeat.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import look_up, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_HEX = r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{8,}(?![0-9A-Za-z])"
_NUMBER = r"[0-9]+"


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path) of a URL column, as the contract cuts them."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        host, slash, tail = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + tail))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def typed_path(path: str = "path") -> Column:
    """The path with what varies by kind replaced by its kind."""
    out = F.regexp_replace(F.col(path), _UUID, "{uuid}")
    return F.regexp_replace(F.regexp_replace(out, _HEX, "{hex}"), _NUMBER, "{n}")


def _kind(segment: Column) -> Column:
    """The kind of a child segment; a branch's distribution over these few kinds is what siblings are compared by."""
    return (
        F.when(segment.isNull(), "none")
        .when(segment == "", "end")
        .when(segment.rlike(r"^\{[a-z]+\}$"), segment)
        .when(segment.rlike(r"\{[a-z]+\}"), F.concat(F.lit("mixed"), F.regexp_extract(segment, r"(\.[A-Za-z0-9]{1,5})?$", 0)))
        .otherwise(F.concat(F.lit("word"), F.regexp_extract(segment, r"(\.[A-Za-z0-9]{1,5})?$", 0)))
    )


def templates(paths: DataFrame, z_limit: float = 3.09, bad_at: float = 0.5) -> DataFrame:
    """(host, typed, template) for distinct ``paths(host, typed, n, labelled, n_bad)``."""
    segments = F.split(F.substring("typed", 2, 1 << 30), "/", -1)
    counts = ["n", "labelled", "n_bad"]
    split = paths.select("host", "typed", *counts, segments.alias("s"))
    # A node is known by two hashes of the segments above it: as text, a long path's prefixes would cost its length squared.
    above = F.array_join(F.slice("s", F.lit(1), F.col("depth")), "/")
    steps = split.select("host", "typed", *counts, "s", F.posexplode("s").alias("depth", "segment")).select(
        "host",
        "typed",
        *counts,
        "depth",
        "segment",
        F.struct(F.xxhash64(F.lit(1), above).alias("x"), F.xxhash64(F.lit(2), above).alias("y")).alias("parent"),
        _kind(F.get("s", F.col("depth") + 1)).alias("kind"),
    )
    branch = ["host", "depth", "parent", "segment"]
    node = ["host", "depth", "parent", "bad"]
    sums = [F.sum("o").alias("o"), F.sum("labelled").alias("labelled"), F.sum("n_bad").alias("n_bad")]
    by_kind = lambda name: F.map_from_entries(F.collect_list(F.struct("kind", "o"))).alias(name)
    steps = settle(steps)
    cells = steps.withColumnRenamed("n", "o").groupBy(*branch, "kind").agg(*sums)
    # One row per branch, and one per side of a node: its kinds as a small map, its size, its labels.
    branches = cells.groupBy(*branch).agg(by_kind("kinds"), F.sum("o").alias("size"), *sums[1:])
    branches = settle(branches.withColumn("bad", (F.col("labelled") > 0) & (F.col("n_bad") >= F.lit(bad_at) * F.col("labelled"))))
    flat = branches.select(*node, "labelled", "n_bad", F.explode("kinds").alias("kind", "o"))
    pool = flat.groupBy(*node, "kind").agg(F.sum("o").alias("o")).groupBy(*node).agg(by_kind("all_kinds"), F.sum("o").alias("all_size"))
    share = (F.sum("n_bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("share")
    fan = branches.groupBy(*node).agg(F.count("*").alias("children"), share)
    sides = settle(pool.join(fan, node).where("children > 1"))
    joined = look_up(branches, sides, node, counts=sides.select(*node, F.col("children").alias("_n")))
    # Chi-squared of a branch against its side: sum of o*o/e over its kinds, less its size.
    expected = lambda kind: F.col("size") * F.col("all_kinds")[kind] / F.col("all_size")
    terms = F.transform(F.map_entries("kinds"), lambda e: e["value"] * e["value"] / expected(e["key"]))
    chi = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) - F.col("size")
    df = F.greatest(F.size("all_kinds") - 1, F.lit(1))
    spread = F.lit(2.0) / (F.lit(9.0) * df)
    z = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - spread)) / F.sqrt(spread)
    gap = F.abs(F.col("n_bad") - F.col("labelled") * F.col("share"))
    agrees = gap <= z_limit * F.sqrt(F.col("labelled") * F.col("share") * (1 - F.col("share")))
    kept_kinds = ~F.col("segment").rlike(r"^(\{[a-z]+\}|)$")
    name = F.when(F.col("bad"), "*bad").otherwise("*")
    merged = settle(joined.where((z <= z_limit) & agrees & kept_kinds).select(*branch, name.alias("merged"), F.col("size").alias("_n")))
    named = look_up(steps.select("host", "typed", *branch[1:]), merged.drop("_n"), branch, "left", counts=merged.select(*branch, "_n"))
    named = named.select("host", "typed", F.struct("depth", F.coalesce("merged", "segment").alias("name")).alias("step"))
    rows = named.groupBy("host", "typed").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return rows.select("host", "typed", F.concat(F.lit("/"), F.array_join(F.transform("steps", lambda s: s["name"]), "/")).alias("template"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    labels: DataFrame | None = None,
    reject_at: float = 0.5,
    prior: float = 0.2,
    weight: float = 4.0,
) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, template, purity.

    ``labels(page_id, bad)`` may add labelled pages; a rule's verdict labels the
    pages that it decides.  ``purity`` is the smoothed share of bad labelled
    pages of the template.
    """
    host, path = url_parts()
    rule, decision = fitting_rule(rules)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), decision.alias("decided"), typed_path().alias("typed"))
    bad = F.when(F.col("decided").isNotNull(), (F.col("decided") == "block").cast("int"))
    if labels is not None:
        given = labels.where("bad is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg((F.avg(F.col("bad").cast("int")) >= 0.5).cast("int").alias("_bad"))
        rows = rows.join(given, "page_id", "left")
        bad = F.coalesce(bad, F.col("_bad"))
    paths = settle(
        rows.withColumn("bad", bad).groupBy("host", "typed").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))
    )
    shaped = settle(paths.join(templates(paths, bad_at=reject_at), ["host", "typed"]))
    purity = (F.sum("n_bad") + F.lit(weight) * F.lit(prior)) / (F.sum("labelled") + F.lit(weight))
    judged = settle(shaped.groupBy("host", "template").agg(purity.alias("purity"), F.count("*").alias("_n")))
    known = look_up(shaped, judged.drop("_n"), ["host", "template"], counts=judged.select("host", "template", "_n"))
    known = settle(known.select("host", "typed", "template", "purity", F.col("n").alias("_n")))
    found = look_up(rows, known.drop("_n"), ["host", "typed"], "left", counts=known.select("host", "typed", "_n"))
    return found.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("decided", F.when(F.col("purity") >= reject_at, "block").otherwise("allow")).alias("verdict"),
        "template",
        "purity",
    )
