"""URL filtering by association rules: FP-growth mines token combinations of labelled URLs, an inverted index applies them.

Fixed host-and-path rules come first (longest wins); where none fits, the mined rules decide, and where none of
those fits either, the URL is allowed.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, map_arrow

#: (host, path, verdict)
FIXED = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.5, 1.1
#: Labelled pages that a rule must hold for at least, however few there are.
LEAST_PAGES = 3
#: Standard deviations that a rule's confidence must lie above the verdict's share of all labelled pages (Wilson's bound).
SURE = 3.0
BLOCK, ALLOW = "label block", "label allow"


def host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty for null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url):
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host_col, path_col, rules=FIXED):
    """(rule, verdict) columns of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(host_col, path_col, url):
    """Distinct tokens of a URL: host suffixes up to three labels, and all host labels, path segments and query names."""
    labels = F.split(host_col, r"\.")
    n = F.size(labels)
    tail = [F.concat(F.lit("suffix "), F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")) for k in (1, 2, 3)]
    each = F.transform(labels, lambda x: F.concat(F.lit("host "), x))
    segments = F.filter(F.split(path_col, "/"), lambda x: x != "")
    parts = F.transform(segments, lambda x: F.concat(F.lit("path "), F.regexp_replace(x, r"\d+", "0")))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query "), x))
    scheme = F.array(F.concat(F.lit("scheme "), F.substring(F.split_part(F.coalesce(url, F.lit("")), F.lit("://"), F.lit(1)), 1, 16)))
    return F.array_distinct(F.concat(F.array(*tail), each, parts, names, scheme))


def mine(labelled: DataFrame, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE, min_lift=MIN_LIFT, least_pages=LEAST_PAGES, sure=SURE) -> list[tuple]:
    """Rules from ``labelled(url, bad)``: (tokens, verdict, confidence, support), best first.

    All labelled rows take part. Rules under the least support (a share of the rows and a number of them), confidence or lift go, and those whose confidence chance may explain, and so does a rule whose
    tokens hold those of a rule of the same verdict that is no less confident. That is decided on the executors, by
    number of tokens: a rule that goes always holds one that stays. All others are kept.
    """
    u = F.col("url")
    items = labelled.select(F.array_append(tokens(host(u), path(u), u), F.when(F.col("bad"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("items"))
    items = cut(items.withColumn("row", F.monotonically_increasing_id()))
    n = items.count()
    least = max(min_support * n, min(least_pages, n))
    alike = _alike(items, least)
    if not alike:
        return []
    items = map_arrow(items, _firsts(alike), "items array<string>")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n * (1 - 1e-9)), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0].isin(BLOCK, ALLOW)).where(F.col("lift") >= min_lift)
    rules = rules.where(~F.array_contains("antecedent", BLOCK) & ~F.array_contains("antecedent", ALLOW))
    c, z2, own = F.col("confidence"), sure * sure, F.col("support") / F.col("confidence") * n
    low = (c + z2 / (2 * own) - sure * F.sqrt(c * (1 - c) / own + z2 / (4 * own * own))) / (1 + z2 / own)
    rules = rules.where(low > c / F.col("lift") + 1e-9)
    rules = rules.select(F.array_sort("antecedent").alias("t"), F.split_part(F.col("consequent")[0], F.lit(" "), F.lit(2)).alias("v"), "confidence", "support")
    rules = cut(rules.withColumn("n", F.size("t")))
    rows: list[tuple] = []
    for n in sorted(r["n"] for r in rules.select("n").distinct().collect()):
        rows += map(tuple, map_arrow(rules.where(F.col("n") == n).drop("n"), _minimal(rows), "t array<string>, v string, confidence double, support double").collect())
    rows = [(sorted(x), *r[1:]) for r in rows for x in product(*(alike[t] for t in r[0]))]
    return sorted(rows, key=lambda r: (-r[2], -r[3], len(r[0]), r[0], r[1]))


def _alike(items: DataFrame, least: float) -> dict[str, list[str]]:
    """Frequent tokens that stand in the same rows, by the first of them: no rule needs two, and each may take the other's place."""
    each = items.select(F.explode("items").alias("t"), F.xxhash64("row").cast("decimal(20,0)").alias("h")).where(~F.col("t").isin(BLOCK, ALLOW))
    found: dict[tuple, list[str]] = defaultdict(list)
    for r in each.groupBy("t").agg(F.count("*").alias("n"), F.sum("h").alias("h")).where(F.col("n") >= least).collect():
        found[r["n"], r["h"]].append(r["t"])
    return {min(x): sorted(x) for x in found.values()}


def _firsts(alike: dict[str, list[str]]):
    def run(batches):
        for b in batches:
            rows = [[t for t in x if t in alike or t in (BLOCK, ALLOW)] for x in b.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["items"])

    return run


def _minimal(kept: list[tuple]):
    """Passes on the rules that hold no rule of ``kept`` with the same verdict and no less confidence."""

    def run(batches):
        least: dict[str, list[tuple]] = defaultdict(list)  # by the first token
        for t, v, c, _ in kept:
            least[t[0]].append((frozenset(t), v, c))
        for b in batches:
            rows = zip(b.column("t").to_pylist(), b.column("v").to_pylist(), b.column("confidence").to_pylist())
            yield b.filter(pa.array([not any(w == v and d >= c and x.issubset(t) for y in t for x, w, d in least.get(y, ())) for t, v, c in rows], pa.bool_()))

    return run


def _matcher(rules: list[tuple]):
    index: dict[str, list[int]] = defaultdict(list)
    for i, (t, *_) in enumerate(rules):
        for x in t:
            index[x].append(i)
    need = [len(r[0]) for r in rules]

    def match(toks: list[str]) -> str:
        seen: dict[int, int] = {}
        best = len(rules)
        for x in toks or ():
            for i in index.get(x, ()):
                seen[i] = n = seen.get(i, 0) + 1
                if n == need[i] and i < best:
                    best = i
        return rules[best][1] if best < len(rules) else "allow"

    def run(batches):
        for b in batches:
            verdict = pa.array([v or match(t) for v, t in zip(b.column("fixed").to_pylist(), b.column("toks").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", doc_id: str = "doc_id") -> DataFrame:
    """One row a page: page_id, host, path, rule (fixed one, else null), verdict (allow or block).

    ``labels(doc_id, quality, toxic)`` speaks of the page of the same id: quality 0 or toxic 1 is bad. Null, empty
    and scheme-less URLs have an empty host and path and fit no fixed rule. Repeated rows are judged one by one;
    without labels or rules every other URL is allowed. Matching is row by row, so no URL can be a hot key.
    """
    bad = labels.select(F.col(doc_id).cast("long").alias("_gl_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("bad is not null and _gl_id is not null")
    bad = bad.groupBy("_gl_id").agg(F.max("bad").alias("bad"))
    rules = mine(pages.select(F.col(page_id).alias("_gl_p"), F.col(url).alias("url")).where("url is not null").join(bad, F.expr("_gl_p = _gl_id")).select("url", "bad"))
    u = F.col("url")
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    base = base.select("page_id", host(u).alias("host"), path(u).alias("path"), "url")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), F.when(verdict.isNull(), tokens(F.col("host"), F.col("path"), u)).alias("toks"))
    return map_arrow(base, _matcher(rules), "page_id long, host string, path string, rule string, verdict string")
