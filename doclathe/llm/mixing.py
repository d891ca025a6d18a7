"""Temperature mixing of sources, DataFrame operations only.

A source's share of all tokens, p, is raised to an exponent x and normalised: w = p^x / sum(p^x). x = 1 keeps the shares, x = 0
makes them equal. Bisection finds x: `entropy` asks for w's entropy as a fraction of its way from p's entropy (0) to that of equal
weights (1); `repeat` asks for the smallest x in [0, 1] at which no source is repeated more than so many times, when the source that is repeated
least is used once. The budget of tokens is by default what uses that source once, so every document stays. Each source's budget is realised
as block permutations: whole passes over the source, then the head of one more pass in the order of a seeded hash, up to the budget
(a document counts if the tokens before it are under it). Ranks inside a pass come from two-level sums over hash bins of bounded
size, so a source that holds a third of all rows is no single task's work.

Defined results: a null text has 0 tokens, as has an empty one; a null source is a source of its own. Sources without tokens have weight 0 and are used once. Ties in
hash order fall back on the id, then on nothing: equal ids have equal fate. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, fresh

STEPS = 60


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\x0b"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "[ \\t-\\r]+"))).cast("long")


def weights(totals: DataFrame, entropy: float | None = None, repeat: float | None = None, budget: int | None = None) -> DataFrame:
    """totals (source, tokens) -> source, tokens, exponent, weight, quota (double tokens), passes (long whole passes), rest (double tokens).

    One row per source; the table of sources is small against the corpus and gathered in one row for the bisection."""
    assert (entropy is None) != (repeat is None)
    one = totals.where("tokens > 0").agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("ts")).withColumn("total", F.aggregate("ts", F.lit(0.0), lambda a, x: a + x))
    one = one.withColumn("ps", F.transform("ts", lambda t: t / F.col("total")))
    add = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda a, p: a + f(p))
    ent = lambda x: (lambda z: F.log(z) - x * add("ps", lambda p: F.pow(p, x) * F.log(p)) / z)(add("ps", lambda p: F.pow(p, x)))
    if entropy is not None:
        one = one.withColumn("goal", ent(F.lit(1.0)) + (F.log(F.size("ps").cast("double")) - ent(F.lit(1.0))) * F.lit(float(entropy)))
        flat_enough = lambda x: ent(x) >= F.col("goal")  # noqa: E731  at too large an x the entropy is below the goal
        step = lambda s, _: F.when(flat_enough((s["lo"] + s["hi"]) / 2), F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi")))
    else:
        # passes over a source are in proportion to p^(x-1)
        spread = lambda x: F.pow(F.element_at("ps", 1), x - 1) / F.pow(F.element_at("ps", -1), x - 1)
        step = lambda s, _: F.when(spread((s["lo"] + s["hi"]) / 2) > F.lit(float(repeat)), F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    one = one.withColumn("exponent", F.round((found["lo"] + found["hi"]) / 2, 9))
    one = one.withColumn("z", add("ps", lambda p: F.pow(p, F.col("exponent"))))
    # The source that is repeated least, the largest, is used once: budget * w = tokens.
    once = F.element_at("ts", -1) * F.col("z") / F.pow(F.element_at("ps", -1), F.col("exponent"))
    one = one.select("exponent", "total", "z", (F.lit(float(budget)) if budget is not None else once).alias("budget"))
    w = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z")).otherwise(0.0)
    out = totals.crossJoin(F.broadcast(one)).withColumn("weight", w).withColumn("quota", F.when(F.col("tokens") > 0, F.round(F.col("budget") * F.col("weight"), 3)).otherwise(0.0))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(F.lit(1)).cast("long")
    return out.withColumn("passes", passes).withColumn("rest", F.when(F.col("tokens") > 0, F.greatest(F.col("quota") - F.col("passes") * F.col("tokens"), F.lit(0.0))).otherwise(0.0)).select("source", "tokens", "exponent", "weight", "quota", "passes", "rest")


def _order(id_: Column, passes: Column, seed: int) -> Column:
    """Place in the extra pass, number `passes`, of a source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), passes.cast("string"), F.coalesce(id_.cast("string"), F.lit("null"))))


def budgets(rows: DataFrame, seed: int = 42, bin_rows: int = 4096, **target) -> DataFrame:
    """rows (id, source, n_tokens) -> one row per source: source, exponent, weight, passes, last (the last order of the extra pass, null if none).

    Bins are ranges of the order. Sums of whole bins find the one in which the budget ends; only its rows, about bin_rows a source, are ranked."""
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    wt = cut(weights(totals.select("source", "tokens"), **target).join(totals.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    w2 = wt.select(F.col("source").alias("s2"), "passes", "rest", F.ceil(F.col("n") / bin_rows).alias("bins"))
    r = rows.join(w2, F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumn("order", _order(F.col("id"), F.col("passes"), seed))
    r = r.withColumn("bin", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("bins") / F.lit(2**32)).cast("long"))
    part = r.groupBy("source", "bin").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("base", F.coalesce(F.sum("t").over(ahead), F.lit(0)))
    end = part.where("base < rest").groupBy(F.col("source").alias("s2")).agg(F.max_by(F.struct("bin", "base"), "bin").alias("x")).select("s2", F.col("x.bin").alias("b2"), F.col("x.base").alias("base"))
    edge = r.join(end, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bin") == F.col("b2")))
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1))
    last = edge.withColumn("upto", F.col("base") + F.coalesce(upto, F.lit(0))).where("upto < rest").groupBy(F.col("source").alias("s2")).agg(F.max("order").alias("last"))
    return cut(wt.join(last, F.col("source").eqNullSafe(F.col("s2")), "left").select("source", "exponent", "weight", "passes", "last"))


def _with_copies(df: DataFrame, id_: Column, source: Column, per: DataFrame, seed: int, small: int) -> tuple[DataFrame, list[str]]:
    """df with exponent, weight and copies, under the three names returned, which no column of df has. Up to `small` sources are broadcast; beyond, Spark joins them."""
    key, exponent, weight, passes, last, copies = fresh(df, "__source", "__exponent", "__weight", "__passes", "__last", "__copies")
    p = per.select(F.col("source").alias(key), F.col("exponent").alias(exponent), F.col("weight").alias(weight), F.col("passes").alias(passes), F.col("last").alias(last))
    out = df.join(F.broadcast(p) if per.count() <= small else p, source.eqNullSafe(F.col(key)))
    extra = F.coalesce(_order(id_, F.col(passes), seed) <= F.col(last), F.lit(False)).cast("long")
    return out.withColumn(copies, F.col(passes) + extra), [exponent, weight, copies]


def plan(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, bin_rows: int = 4096, tokens: Column | None = None, small: int = 100_000, **target) -> DataFrame:
    """id, source, n_tokens, exponent, weight, copies: how many times each row of df is used. target: see weights()."""
    rows = cut(df.select(df[id_col].alias("id"), df[source].alias("source"), (words(df[text]) if tokens is None else tokens).alias("n_tokens")))
    out, (exponent, weight, copies) = _with_copies(rows, F.col("id"), F.col("source"), budgets(rows, seed, bin_rows, **target), seed, small)
    return out.select(F.col("id").alias(id_col), "source", "n_tokens", F.col(exponent).alias("exponent"), F.col(weight).alias("weight"), F.col(copies).alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, bin_rows: int = 4096, small: int = 100_000, **target) -> DataFrame:
    """df's rows, all columns, each as often as planned. Texts aren't shuffled: a row's copies follow from its id and its source's row."""
    rows = cut(df.select(df[id_col].alias("id"), df[source].alias("source"), words(df[text]).alias("n_tokens")))
    out, (_, _, copies) = _with_copies(df, df[id_col], df[source], budgets(rows, seed, bin_rows, **target), seed, small)
    each = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(fresh(out, "__copy")[0])
    return out.where(F.col(copies) > 0).select("*", each).select(*[df[c] for c in df.columns])


def schedule(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, **target) -> DataFrame:
    """The block permutations themselves: id, source, pass, order, one row per use. A source's pass is all its documents in the order of `order`; the last pass is
    the head of such a permutation. Readers sort by (pass, order) inside a source, or merge sources by order."""
    p = plan(df, id_col, text, source, seed, **target).where("copies > 0")
    each = p.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select(id_col, "source", "pass", _order(F.col(id_col), F.col("pass"), seed).alias("order"))
