"""Mixing overlapping sources to target weights by minimum-cost flow.

Texts are aggregated by membership pattern: the set of sources that hold the same text. Word capacity flows from each
pattern to the quotas of its sources. The k-th use of a pattern's distinct words, whatever source it goes through, costs
k squared a word (convex), so texts that several sources hold are repeated less than they would be source by source. The flow
decides how many words each source takes of each pattern; whole documents are then taken in a seeded order.
"""

from __future__ import annotations

from array import array
from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, cut

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 42
#: Hash ranges of a pattern in one level of the search for the point up to which documents are taken.
FAN = 256
LEVELS = 3
#: Up to so many pairs of pattern and source, what the driver found for them is broadcast (under 200 bytes each).
BROADCAST_GROUPS = 50_000
#: Up to so many texts that several sources hold, their patterns are broadcast (16 bytes each), so documents stay where they are.
BROADCAST_TEXTS = 1_000_000


def fill(sizes: dict, weights: dict, total: float, cap: float = MAX_REPEAT) -> dict:
    """Targets: ``total`` shared by weight, none above ``cap`` times its size, the excess reshared by weight."""
    out: dict = {}
    left, open_ = float(total), dict(weights)
    while open_:
        w = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / w > cap * sizes[s]]
        if not over:
            return out | {s: left * x / w for s, x in open_.items()}
        for s in over:
            out[s] = float(cap * sizes[s])
            open_.pop(s)
        left = float(total) - sum(out.values())
    return out


def cost(uses: int) -> int:
    """Of the k-th use of a word: k squared; from the fifth on that of the next power of two, so that there are few levels."""
    return uses * uses if uses <= 4 else (1 << (uses - 1).bit_length()) ** 2


def min_cost_flow(patterns: dict, quotas: dict, repeat: int = MAX_REPEAT) -> dict[tuple, int]:
    """Words that each source takes of each pattern, so that as much of the quotas as can be is met at least cost.

    ``patterns``: key to (words of its distinct texts, {source: words of its documents}); a source takes no document
    more than ``repeat`` times. Flow runs from the start over pattern and source to the end. Uses of equal cost are
    opened together, cheapest first, and the flow is augmented as far as it goes: what a pattern gives is a
    polymatroid and costs rise, so no cheaper use has to be given back, and the flow of least cost is found.
    """
    names = sorted({s for _, own in patterns.values() for s in own}, key=repr)
    keys = list(patterns)
    place = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    # arrays, since there may be very many patterns: 8 or 4 bytes a number
    to, cap, out = array("i"), array("q"), [array("q") for _ in range(2 + len(keys) + len(names))]

    def arc(a, b, c):
        for x, y, z in ((a, b, c), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)

    first, via = {}, {}
    for i, p in enumerate(keys):
        first[p] = len(to)
        arc(0, 2 + i, 0)
        for s in sorted(patterns[p][1], key=repr):
            via[p, s] = len(to)
            arc(2 + i, place[s], repeat * patterns[p][1][s])
    ends = range(len(to), len(to) + 2 * len(names), 2)
    for s in names:
        arc(place[s], 1, int(quotas.get(s, 0)))
    most = {p: repeat * sum(own.values()) for p, (_, own) in patterns.items()}
    opened, uses = dict.fromkeys(keys, 0), 1
    while any(opened[p] < most[p] for p in keys):
        for p in keys:
            upto = min(most[p], patterns[p][0] * uses)
            cap[first[p]] += max(0, upto - opened[p])
            opened[p] = max(opened[p], upto)
        _augment(out, to, cap)
        uses = uses + 1 if uses < 4 else 2 * uses
        if not any(cap[e] for e in ends) or not any(patterns[p][0] for p in keys):
            break
    return {x: cap[e + 1] for x, e in via.items()}


def _augment(out: list, to: list, cap: list) -> None:
    """Augments the flow from node 0 to node 1 until it is the largest, along shortest paths level by level."""
    while True:
        depth = [-1] * len(out)
        depth[0], todo = 0, deque([0])
        while todo:
            x = todo.popleft()
            for e in out[x]:
                if cap[e] and depth[to[e]] < 0:
                    depth[to[e]] = depth[x] + 1
                    todo.append(to[e])
        if depth[1] < 0:
            return
        at = [0] * len(out)
        path: list[int] = []
        x = 0
        while True:
            if x == 1:
                push = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if not cap[e])
                x = to[path[k] ^ 1]
                del path[k:]
            elif at[x] < len(out[x]):
                e = out[x][at[x]]
                if cap[e] and depth[to[e]] == depth[x] + 1:
                    path.append(e)
                    x = to[e]
                else:
                    at[x] += 1
            elif path:
                x = to[path.pop() ^ 1]
                at[x] += 1
            else:
                break


def _stops(slim: DataFrame, given: DataFrame, side) -> DataFrame:
    """``(g, times, stop, gap)``: each document of a group is used ``times`` times, those with ``spread < stop`` once more, and ``gap`` words are then missing.

    A count of words by hash range, refined ``LEVELS`` times, finds where to stop; no task sorts a group. ``side``
    broadcasts what there is one row a group of, where that is small, so documents are not dealt out by group.
    """
    base = given.select("g", F.expr("words div total").alias("times"), F.expr("words % total").alias("rest"))
    state = base.select("g", F.lit(0).cast("long").alias("stop"), F.col("rest").alias("gap"))
    for level in range(LEVELS):
        width = FAN ** (LEVELS - 1 - level)
        here = slim.join(side(state), "g").where(F.expr(f"spread div {width * FAN} * {width * FAN} = stop"))
        counts = here.groupBy("g", F.expr(f"spread div {width}").alias("range"), "gap").agg(F.sum("size").alias("words"))
        sums = counts.withColumn("upto", F.sum("words").over(Window.partitionBy("g").orderBy("range")))
        found = sums.groupBy("g").agg(
            F.min(F.when(F.col("upto") > F.col("gap"), F.col("range"))).alias("at"),
            F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("full"),
        )
        state = cut(
            state.join(found, "g", "left").select(
                "g", F.coalesce(F.col("at") * width, F.lit(FAN**LEVELS)).alias("stop"), (F.col("gap") - F.coalesce("full", F.lit(0))).alias("gap")
            )
        )
    return state.join(base.select("g", "times"), "g")


def _fillers(slim: DataFrame, stops: DataFrame, side) -> list[tuple]:
    """A few documents beyond the stop, by falling size, that fill the gap of each group: ``(g, hash, size)``.

    Four candidates of each power of two of size are looked at, so the driver gets some hundred rows a group at most.
    """
    after = slim.join(side(stops.where("gap > 0")), "g").where("spread >= stop and size <= gap")
    alike = after.groupBy("g", "gap", "hash", F.floor(F.log2("size")).alias("power")).agg(F.sum("size").alias("size"))
    picks = alike.groupBy("g", "gap", "power").agg(
        *(f(F.struct(*cols)).alias(n) for n, f, cols in (("a", F.min, ("hash", "size")), ("b", F.max, ("hash", "size")), ("c", F.min, ("size", "hash")), ("d", F.max, ("size", "hash"))))
    )
    one = F.array(*(F.struct(F.col(f"{x}.size").alias("size"), F.col(f"{x}.hash").alias("hash")) for x in "abcd"))
    rows = picks.select("g", "gap", F.explode(one).alias("x")).select("g", "gap", "x.size", "x.hash").distinct().collect()
    chosen, gap = [], {}
    for r in sorted(rows, key=lambda r: (r["g"], -r["size"], r["hash"])):
        if r["size"] <= gap.setdefault(r["g"], r["gap"]):
            chosen.append((r["g"], r["hash"], r["size"]))
            gap[r["g"]] -= r["size"]
    return chosen


def broadcast_if(small: bool):
    return F.broadcast if small else (lambda df: df)


@dataclass
class Mix:
    """What was decided for each group of a pattern and a source; ``uses`` applies it to rows of ``keyed``."""

    plan: DataFrame
    fillers: DataFrame
    shared: DataFrame
    small: bool

    def uses(self, df: DataFrame, source: str, hash_: str, text_hash: str, filled: str) -> DataFrame:
        """``df`` with _gl_source_size, _gl_target and _gl_uses; ``filled``: SQL that is true for rows with words."""
        side = broadcast_if(self.small)
        out = _with_group(df, self.shared, source, text_hash, filled)
        out = out.join(side(self.plan), F.col("_gl_g") == F.col("_gl_pg"), "left")
        out = out.join(side(self.fillers), (F.col("_gl_g") == F.col("_gl_fg")) & (F.col(hash_) == F.col("_gl_fh")), "left")
        more = F.expr(f"cast(pmod({hash_}, {FAN**LEVELS}) < _gl_stop or _gl_fh is not null as long)")
        uses = F.when(F.expr(filled), F.least(F.coalesce("_gl_times", F.lit(0)) + F.coalesce(more, F.lit(0)), F.lit(MAX_REPEAT)))
        return out.withColumn("_gl_uses", F.coalesce(uses, F.lit(0)).cast("long")).drop("_gl_g", "_gl_pg", "_gl_fg", "_gl_fh", "_gl_stop", "_gl_times")


def _with_group(df: DataFrame, shared: DataFrame, source: str, text_hash: str, filled: str) -> DataFrame:
    """``df`` with _gl_g, the group of the row's source and the pattern of its text."""
    out = df.join(shared, F.col(text_hash) == F.col("_gl_st"), "left")
    own = F.xxhash64(F.lit(1), F.col(source))
    pattern = F.when(F.expr(filled), F.coalesce(F.col("_gl_pattern"), own)).otherwise(own)
    return out.withColumn("_gl_g", F.xxhash64(pattern, F.col(source))).drop("_gl_st", "_gl_pattern")


def keyed(docs: DataFrame, doc_id: str, text: str, seed: int = SEED) -> DataFrame:
    """``docs`` with _gl_hash, the seeded place of each row, and _gl_th, the hash of its text."""
    return docs.withColumns({"_gl_hash": F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), "_gl_th": F.xxhash64(F.col(text))})


def sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, hash, th, spread) of all rows, written to the shared folder."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = keyed(docs, doc_id, text, seed).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.col("_gl_hash").alias("hash"), F.col("_gl_th").alias("th"))
    return cut(slim.withColumn("spread", F.pmod("hash", F.lit(FAN**LEVELS))))


def memberships(slim: DataFrame, most: int | None = None) -> tuple[DataFrame, dict]:
    """(_gl_st, _gl_pattern) of the texts that several sources hold; patterns as :func:`min_cost_flow` takes them.

    Rows are first put together by text and source, so a text that very many rows hold is one row a source after that.
    Texts of one source make up that source's own pattern. All patterns are returned, however many there are; only a
    caller who gives ``most`` gets those with the most words alone, and texts of the others then count with their own source's.
    """
    filled = slim.where("size > 0")
    held = cut(filled.groupBy("th", "source").agg(F.max("size").alias("size")))
    many = held.groupBy("th").agg(F.array_sort(F.collect_list(F.struct("source"))).alias("sources"), F.max("size").alias("size")).where("size(sources) > 1")
    many = cut(many.select("th", F.xxhash64("sources").alias("pattern"), "size"))
    found = many.groupBy("pattern").agg(F.sum("size").alias("words"))
    top = (found if most is None else found.orderBy(F.desc("words"), "pattern").limit(most + 1)).collect()
    if most is not None and len(top) > most:
        top = top[:most]
        many = cut(many.join(F.broadcast(slim.sparkSession.createDataFrame([(r["pattern"],) for r in top], "pattern long")), "pattern", "left_semi"))
    shared = many.select(F.col("th").alias("_gl_st"), F.col("pattern").alias("_gl_pattern"))
    shared = broadcast_if(shared.count() <= BROADCAST_TEXTS)(shared)
    alone = held.join(many.select("th"), "th", "left_anti").groupBy("source").agg(F.sum("size").alias("words")).collect()
    grouped = cut(filled.join(shared, F.col("th") == F.col("_gl_st"), "left").select(F.col("_gl_pattern").alias("pattern"), "source", "size"))
    words = {r["pattern"]: r["words"] for r in top}
    patterns: dict = {(None, r["source"]): (r["words"], {}) for r in sorted(alone, key=repr)} | {(p, None): (words[p], {}) for p in sorted(words)}
    for r in sorted(grouped.groupBy("pattern", "source").agg(F.sum("size").alias("n")).collect(), key=repr):
        patterns[(None, r["source"]) if r["pattern"] is None else (r["pattern"], None)][1][r["source"]] = r["n"]
    return shared, patterns


def plan_mix(slim: DataFrame, weights=WEIGHTS) -> Mix:
    """Targets, flow and stops for the rows of :func:`sized`.

    Sources in order of code points, null last, weigh 5, 2, 1 and so on. The driver holds one row a source and one a
    pair of a pattern and a source of it, of all patterns. Of each source the largest group is planned last and makes up for
    what whole documents left open in the others.
    """
    spark, kind = slim.sparkSession, slim.schema["source"].dataType.simpleString()
    sizes = {r[0]: r[1] for r in slim.groupBy("source").agg(F.sum("size").alias("total")).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in str(s)]) + [None] * (None in sizes)
    targets = fill(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, sum(sizes.values()))
    quotas = {s: round(t) for s, t in targets.items()}
    shared, patterns = memberships(slim)
    given = min_cost_flow(patterns, quotas)
    rows = [(p[0], s, patterns[p][1][s], words) for (p, s), words in given.items()]
    rows += [(None, s, 0, 0) for s in order if (None, s) not in patterns]
    own = F.xxhash64(F.lit(1), "source")
    named = spark.createDataFrame(rows, f"pattern long, source {kind}, total long, words long").withColumn("g", F.xxhash64(F.coalesce("pattern", own), "source"))
    groups = named.select("g", "source", "total", "words").collect()
    small = len(groups) <= BROADCAST_GROUPS
    side = broadcast_if(small)
    last = {}
    for r in groups:
        if r["total"] and (r["source"] not in last or (r["total"], r["g"]) > last[r["source"]]):
            last[r["source"]] = (r["total"], r["g"])
    closing = {g for _, g in last.values()}
    filled = cut(_with_group(slim.where("size > 0"), shared, "source", "th", "size > 0").select(F.col("_gl_g").alias("g"), "size", "hash", "spread"))
    taken: dict = defaultdict(int)
    stops, fillers = [], []
    for final in (False, True):
        now = []
        for r in groups:
            if r["total"] and (r["g"] in closing) == final:
                words = min(MAX_REPEAT * r["total"], max(0, quotas[r["source"]] - taken[r["source"]])) if final else r["words"]
                now.append((r["g"], r["total"], words))
        if not now:
            continue
        plan = spark.createDataFrame(now, "g long, total long, words long")
        found = cut(_stops(filled.join(side(plan.select("g")), "g", "left_semi") if not small else filled, plan, side))
        more = _fillers(filled, found, side)
        stops.append(found)
        fillers += more
        if not final:
            gap = {r["g"]: r["gap"] for r in found.select("g", "gap").collect()}
            for g, _, size in more:
                gap[g] -= size
            of = {r["g"]: r["source"] for r in groups}
            for g, _, words in now:
                taken[of[g]] += words - gap[g]
    facts = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in order], f"source {kind}, size long, target double")
    known = named.select("g", "source").join(facts.withColumnRenamed("source", "s"), F.expr("source <=> s"))
    state = stops[0] if len(stops) == 1 else stops[0].unionByName(stops[1]) if stops else spark.createDataFrame([], "g long, stop long, gap long, times long")
    plan = known.join(state.withColumnRenamed("g", "_gl_sg"), F.col("g") == F.col("_gl_sg"), "left").select(
        F.col("g").alias("_gl_pg"), F.col("size").alias("_gl_source_size"), F.col("target").alias("_gl_target"), F.col("times").alias("_gl_times"), F.col("stop").alias("_gl_stop")
    )
    return Mix(cut(plan), spark.createDataFrame([x[:2] for x in fillers], "_gl_fg long, _gl_fh long"), shared, small)


def mixed_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a document: doc_id, size, source_size, target (of its source), taken (words the mix takes, repeats counted).

    Size is the number of words; null and empty texts have size zero and give nothing. Documents are taken whole, at
    most three times. Rows alike in id and text share a seeded place and are taken alike where their source is the same. A
    null source is a source of its own. No documents give no rows; a rerun gives the same rows.
    """
    slim = sized(docs, doc_id, text, source)
    out = plan_mix(slim).uses(slim, "source", "hash", "th", "size > 0")
    return out.select("doc_id", "size", F.col("_gl_source_size").alias("source_size"), F.col("_gl_target").alias("target"), (F.col("_gl_uses") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix uses them (none to three times), with their columns.

    Null and empty texts, and so those without words, are not taken. Ties, repeated rows, null sources and empty input
    as in :func:`mixed_sizes`.
    """
    mix = plan_mix(sized(docs, doc_id, text, source))
    out = mix.uses(keyed(docs, doc_id, text), source, "_gl_hash", "_gl_th", f"coalesce(regexp_like({text}, '[^ \\\\x09-\\\\x0D]'), false)")
    return out.where("_gl_uses > 0").withColumn("_gl_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_gl_uses")))).select(*docs.columns)
