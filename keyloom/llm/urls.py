"""URL filters by hashed host-suffix and path-prefix expressions (native: DataFrame functions only).

Rules are pairs of a host and the start of a path. A URL is expanded into the
combinations of its host's suffixes (at label borders, as many labels as a rule has
at most) with prefixes of its path (of the lengths that rules have). Each expression's
SHA-256 is cut to a short prefix for the equi-join with the rules, and a hit counts
only if the full digests agree. Of the rules that fit, the longest wins; of equally
long ones that with the longer host, then block before allow, then the first in order.

The rules are broadcast if they are at most BROADCAST_RULES; else the join shuffles.

Rows: one for each input row. Null URLs and those without ``://`` have empty host and
path and no rule. Empty rule tables: no rule fits. Repeated rows get equal results.
Very long URLs are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import ascii_lower, fits

BROADCAST_RULES = 100_000
#: Hexadecimal digits of the short hash prefix.
SHORT = 8

#: Rules of the registered query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), otherwise: str = "allow") -> DataFrame:
    """``keep``, host, path, rule, verdict. ``rules`` has verdict, host and path."""
    host, path = host_and_path(pages[url])
    own = pages.select(F.struct(*[pages[c] for c in keep]).alias("k"), host.alias("host"), path.alias("path"))
    known = rules.select(
        F.col("verdict").alias("r_verdict"),
        ascii_lower(F.col("host")).alias("r_host"),
        F.coalesce(F.col("path"), F.lit("")).alias("r_path"),
    ).where("r_host is not null and r_verdict is not null")
    known = known.withColumn("digest", _digest(F.col("r_host"), F.col("r_path"))).distinct()
    shape = known.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    labels, lengths = shape["labels"] or 0, sorted(shape["lengths"])
    # the rules behind a short prefix: one, or a few whose digests begin alike
    index = known.groupBy(F.substring("digest", 1, SHORT).alias("short")).agg(F.collect_list(F.struct("digest", "r_host", "r_path", "r_verdict")).alias("rules"))
    if fits(known, BROADCAST_RULES):
        index = F.broadcast(index)

    # one line for each distinct place, however many pages have it
    places = own.where("host <> ''").select("host", "path").distinct()
    suffixes = F.expr(f"transform(sequence(1, greatest(1, least(size(split(host, '[.]')), {max(1, labels)}))), n -> substring_index(host, '.', -n))")
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(sizes, lambda n: F.struct(h.alias("h"), F.substr(F.col("path"), F.lit(1), n).alias("p")))))
    expanded = places.select("host", "path", F.explode(expressions).alias("e"))
    expanded = expanded.select("host", "path", _digest(F.col("e.h"), F.col("e.p")).alias("digest"))
    met = expanded.join(index, F.substring(expanded["digest"], 1, SHORT) == F.col("short"))
    hits = met.select("host", "path", F.explode(F.filter("rules", lambda r: r["digest"] == met["digest"])).alias("r"))  # full digests decide
    rank = F.struct(
        (-(F.length("r.r_host") + F.length("r.r_path"))).alias("size"), (-F.length("r.r_host")).alias("host_size"),
        F.when(F.col("r.r_verdict") == "block", 0).otherwise(1).alias("soft"), F.col("r.r_host").alias("h"), F.col("r.r_path").alias("p"), F.col("r.r_verdict").alias("v"),
    )
    best = hits.groupBy("host", "path").agg(F.min(rank).alias("best")).select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    # rows without a host fit no rule; a key of null keeps them from meeting in one task
    key = F.when(F.col("host") != "", F.col("host"))
    return own.join(best, (key == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").select(
        *[F.col("k").getField(c).alias(c) for c in keep],
        "host",
        "path",
        F.concat(F.col("best.h"), F.col("best.p")).alias("rule"),
        F.coalesce(F.col("best.v"), F.lit(otherwise)).alias("verdict"),
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)
