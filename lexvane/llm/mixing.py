"""Mixing sources to target weights by iterative proportional fitting.

Token weights of (source, language, topic) cells are raked: scaled in turn so that each margin meets its targets, until no margin
moves. That gives the weights. The probabilities are raked under the bound that no cell can be kept more than whole: cells at the
bound stay there and the others make up for them, until the margins of the expected kept tokens meet the targets. A hash of the
document decides, so that runs agree. Only DataFrame operations are used; the table of cells is aggregated before anything else
is done with it.

Where a value has too few tokens for its target at the wanted share, fewer tokens are kept in all: the most that the targets allow,
but no less than ``least``, so that a value with hardly any tokens does not take the corpus with it: it is kept whole then.
Margins without targets never lower what is kept: their values with too few tokens are kept whole and fall short of their share.
Targets of several margins that no choice of documents meets together are met in the last margin only; a warning names what is missed.

Targets are shares of tokens by value. A margin without targets keeps its shares to the power ``temper``, which evens out sources
of unlike sizes. Values without a target keep their own share within what the targets leave over.

Defined cases: a null or empty text has no tokens and is kept with the probability of its cell; null source, language or topic is
a value of its own; equal rows share a fate; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexvane.llm.common import stored, unused_name, whole_text

_MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixParams:
    targets: dict[str, dict[str, float]] = field(default_factory=lambda: {"lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}})
    temper: float = 0.5
    #: Share of all tokens that is wanted, at most.
    keep: float = 0.7
    #: Share of all tokens that is kept at least, even where that leaves a value with too few tokens short of its target.
    least: float = 0.0
    rounds: int = 30
    #: So many cells or fewer are raked in one partition.
    few_cells: int = 100_000
    tolerance: float = 1e-4
    seed: int = 11


def topic_of(text: Column) -> Column:
    """A coarse kind of text, by signs and lines over the whole text: a stand-in where no topic column is given."""
    size = F.greatest(F.char_length(text), F.lit(1))
    signs = F.char_length(text) - F.char_length(F.translate(text, "%$&*#|", ""))
    lines = F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1
    return F.when(signs > 0.05 * size, "signs").when(size < 200, "short").when(size / lines < 60, "lists").otherwise("prose")


def token_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.when(F.char_length(text) > 0, F.regexp_count(text, F.lit(r"\S+"))).otherwise(0).cast("long")


def _spread(cells: DataFrame, margin: str, p: MixParams) -> DataFrame:
    """(value, target share) of a margin."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    whole = Window.partitionBy(F.lit(0))  # as many rows as the margin has values
    wanted = p.targets.get(margin)
    if not wanted:
        raised = own.withColumn("x", F.pow(F.col("t").cast("double"), F.lit(p.temper)))
        return raised.select(margin, (F.col("x") / F.greatest(F.sum("x").over(whole), F.lit(1e-300))).alias("goal"))
    given = F.coalesce(*[F.when(F.col(margin) == k, F.lit(float(v))) for k, v in wanted.items()])
    there = own.withColumn("given", F.when(F.col("t") > 0, given)).withColumn("free", F.when(F.col("given").isNull(), F.col("t")).otherwise(0))
    left = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("given").over(whole), F.lit(0.0)))
    goal = F.coalesce("given", left * F.col("free") / F.greatest(F.sum("free").over(whole), F.lit(1)))
    there = there.withColumn("x", goal)
    return there.select(margin, (F.col("x") / F.greatest(F.sum("x").over(whole), F.lit(1e-300))).alias("goal"))


def rake(cells: DataFrame, p: MixParams) -> DataFrame:
    """``cells``: source, lang, topic, tokens, n. Adds weight, whose margins meet the targets, in tokens of the whole."""
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in _MARGINS:
        goals = _spread(cells, m, p).withColumnRenamed(m, "v").withColumnRenamed("goal", f"goal_{m}")
        now = now.join(goals, F.col(m).eqNullSafe(F.col("v")), "left").drop("v")
    now = stored(now, "mix-cells")
    last = float("inf")
    for _ in range(p.rounds):
        for m in _MARGINS:
            sums = F.sum("weight").over(Window.partitionBy(m))
            now = now.withColumn("weight", F.when(sums > 0, F.col("weight") * F.col(f"goal_{m}") * F.lit(float(total)) / sums).otherwise(0.0))
        now = stored(now, "mix-cells")
        off = max(now.groupBy(m).agg((F.abs(F.sum("weight") - F.first(f"goal_{m}") * float(total)) / max(1, total)).alias("d")).agg(F.max("d")).first()[0] or 0.0 for m in _MARGINS)
        if off < p.tolerance or off > 0.98 * last:  # met, or no nearer than before
            break
        last = off
    if off >= p.tolerance:
        warnings.warn(f"mixing: a margin's weight is still {off:.4f} of all tokens off its target", stacklevel=3)
    return now.select(*_MARGINS, "tokens", "n", "weight")


def _scaled(df: DataFrame, have: str, pull: str, goal: Column, by: list[str]) -> DataFrame:
    """Adds _f for each group of ``by``, so that sum(min(have, _f * pull)) is ``goal``, or all that rows with a pull have where that is less."""
    whole = Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)]))
    order = whole.orderBy(F.try_divide(have, pull).asc_nulls_last())
    ranked = df.withColumn("_k", F.row_number().over(order))
    by_rank = whole.orderBy("_k")
    before = F.coalesce(F.sum(have).over(by_rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(pull).over(by_rank.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The sum is the least of what is got by holding the first k rows at what they have, so the largest of these factors is right.
    each = ranked.withColumn("_f", F.when(F.col(pull) > 0, (goal - before) / rest))
    return each.withColumn("_f", F.coalesce(F.greatest(F.max("_f").over(whole), F.lit(0.0)), F.lit(1.0))).drop("_k")


def _feasible(cells: DataFrame, p: MixParams) -> tuple[DataFrame, float]:
    """``cells`` with want_{margin}, the tokens to keep of the cell's value, and how many tokens are kept in all.

    Margins with targets get their shares, of fewer tokens than ``keep`` where a value has too few. Values of the other margins
    are held at the tokens they have, and what they lack goes to the others in proportion.
    """
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    spreads = {m: stored(_spread(cells, m, p).join(cells.groupBy(F.col(m).alias("v")).agg(F.sum("tokens").cast("double").alias("have")), F.col(m).eqNullSafe(F.col("v"))).drop("v"), "mix-goals") for m in _MARGINS}
    wanted = p.keep * total
    for m, s in spreads.items():
        most = F.min(F.when(F.col("goal") > 0, F.col("have") / F.col("goal"))) if p.targets.get(m) else F.sum(F.when(F.col("goal") > 0, F.col("have")))
        wanted = min(wanted, s.agg(most).first()[0] or 0.0)
    wanted = max(wanted, min(p.least, p.keep) * total)
    for m, s in spreads.items():
        want = F.least("have", F.col("_f") * F.col("goal"))
        goals = _scaled(s, "have", "goal", F.lit(wanted), []).select(F.col(m).alias("v"), want.alias(f"want_{m}"), F.col("goal").alias(f"goal_{m}"))
        cells = cells.join(goals, F.col(m).eqNullSafe(F.col("v")), "left").drop("v")
    return cells, wanted


def rake_kept(cells: DataFrame, p: MixParams) -> DataFrame:
    """``cells`` and prob, such that the margins of the expected kept tokens sum(tokens * prob) meet the targets.

    Fitting as in ``rake``, but of min(tokens, tokens * pull): cells that are kept whole stay so and the others make up for
    them. Margins with targets are fitted last. A warning names the values that miss their share.
    """
    now, wanted = _feasible(cells, p)
    # Few cells are taken in one partition, where no window or sum has to shuffle them; more are dealt out by margin.
    few = cells.count() <= p.few_cells
    gathered = lambda df: df.coalesce(1) if few else df
    now = gathered(stored(now.withColumn("have", F.col("tokens").cast("double")).withColumn("pull", F.lit(1.0)), "mix-cells"))
    kept = F.least("have", F.col("have") * F.col("pull"))
    last = float("inf")
    for _ in range(p.rounds):
        for m in sorted(_MARGINS, key=lambda m: bool(p.targets.get(m))):
            now = _scaled(now.withColumn("_y", F.col("have") * F.col("pull")), "have", "_y", F.col(f"want_{m}"), [m])
            now = now.withColumn("pull", F.least(F.col("pull") * F.col("_f"), F.lit(1e100))).drop("_y", "_f")
        now = gathered(stored(now, "mix-cells"))
        off = [F.abs(F.sum(kept).over(Window.partitionBy(m)) - F.col(f"want_{m}")).alias(m) for m in _MARGINS]
        d = now.select(F.greatest(*off).alias("d")).agg(F.max("d")).first()[0] or 0.0
        if d <= p.tolerance * wanted or d > 0.98 * last:
            break
        last = d
    share = F.sum(kept) / max(1.0, wanted)
    for m in _MARGINS:
        missed = now.groupBy(m).agg(share.alias("share"), F.first(f"goal_{m}").alias("goal")).where(F.abs(F.col("share") - F.col("goal")) > 0.01)
        if rows := missed.orderBy(F.abs(F.col("share") - F.col("goal")).desc()).take(20):
            warnings.warn(f"mixing: expected shares of kept tokens miss those wanted, by {m}: " + ", ".join(f"{r[0]} {r.share:.3f} for {r.goal:.3f}" for r in rows), stacklevel=3)
    return now.select(*_MARGINS, F.least(F.lit(1.0), "pull").alias("prob"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, params: MixParams = MixParams()) -> DataFrame:
    """``df`` and the columns mix_topic, mix_tokens, mix_weight (of the document's cell, for each token), mix_prob, mix_keep."""
    p = params
    names = [unused_name(df, x) for x in ("mix_topic", "mix_tokens", "mix_weight", "mix_prob", "mix_keep")]
    text = whole_text(text_col)
    keys = {"source": F.col(source_col).cast("string"), "lang": F.col(lang_col).cast("string"), "topic": (topic_of(text) if topic is None else topic).cast("string")}
    about = df.select(*[e.alias(k) for k, e in keys.items()], token_count(text).alias("tokens"))
    cells = stored(about.groupBy(*_MARGINS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-counts")
    inner = {m: unused_name(df, f"_mix_{m}") for m in _MARGINS}
    raked = rake(cells, p).select(*[F.col(m).alias(inner[m]) for m in _MARGINS], F.coalesce(F.try_divide("weight", "tokens"), F.lit(1.0)).alias(names[2]))
    same = [F.col(inner[m]).eqNullSafe(F.col(m)) for m in _MARGINS]
    probs = stored(raked.join(rake_kept(cells, p), same).select(*raked.columns, F.col("prob").alias(names[3])), "mix-raked")
    u = F.pmod(F.xxhash64(F.col(id_col), text, F.lit(p.seed)), F.lit(2**53)) / F.lit(float(2**53))
    out = df.withColumn(names[0], keys["topic"]).withColumn(names[1], token_count(text))
    # Spark broadcasts the cells only where their size is under its threshold; else it shuffles and splits skewed parts.
    match = keys["source"].eqNullSafe(F.col(inner["source"])) & keys["lang"].eqNullSafe(F.col(inner["lang"])) & F.col(names[0]).eqNullSafe(F.col(inner["topic"]))
    joined = out.join(probs, match, "left").withColumn(names[4], u < F.col(names[3]))
    return joined.select(*df.columns, *names)
